"""The command line on a small card."""

import json

import pytest

from stratalog import cli, settings

JPEG = b"\xff\xd8\xff\xe0rest of "


def test_commands(spark, tmp_path, capsys):
    card, archive = tmp_path / "card", str(tmp_path / "archive")
    card.mkdir()
    (card / "a.jpg").write_bytes(JPEG + b"1")
    (card / "b.jpg").write_bytes(JPEG + b"1")
    (card / "b.xmp").write_text('<x><rdf:Description rdf:about=""></rdf:Description></x>')
    (card / "n.txt").write_bytes(b"x")

    def run(*args):
        code = cli.main(list(args), spark)
        return code, capsys.readouterr().out

    code, out = run("sort", "--source", str(card), "--dest", archive, "--camera-owner", "me")
    assert code == 0 and json.loads(out)["processed"] == 2
    assert "<aux:OwnerName>me</aux:OwnerName>" in next(p for p in (tmp_path / "archive" / "duplicates").rglob("*.xmp")).read_text()
    assert run("verify", "--dest", archive)[0] == 0
    for what in ("runs", "duplicates", "errors", "skipped", "inventory"):
        assert json.loads(run("query", what, "--dest", archive, "--json")[1])["query"] == what
    run_id = json.loads(run("query", "runs", "--dest", archive, "--json")[1])["results"][0]["id"]
    assert json.loads(run("query", "run", "--dest", archive, "--json", "--run", run_id[:8])[1])["summary"]["total"] == 2
    assert run("query", "duplicates", "--dest", archive, "--list")[1].strip().endswith("b.jpg")
    assert len(json.loads(run("query", "duplicates", "--dest", archive, "--pairs", "--json")[1])["results"]) == 1
    assert len(json.loads(run("query", "files", "--dest", archive, "--json", "--source", str(card))[1])["results"]) == 2
    assert len(json.loads(run("query", "files", "--dest", archive, "--json", "--from", "1902-02-20", "--to", "1902-02-20")[1])["results"]) == 2
    assert "UNRECOGNIZED" in run("status", "--source", str(card))[1]
    assert "Unsupported format" in run("doctor", "--source", str(card))[1]
    assert "total" in run("stats", "--dest", archive)[1]
    assert json.loads(run("clean", "--dest", archive)[1].splitlines()[0])["compacted"]
    assert run("version")[1].strip() == cli.VERSION
    damaged = next((tmp_path / "archive" / "1902").rglob("*.jpg"))
    damaged.write_bytes(b"\xff\xd8\xffother")
    assert run("verify", "--dest", archive)[0] == 1
    with pytest.raises(SystemExit):
        run("query", "runs", "--dest", archive, "--json", "--list")


def test_settings(spark, tmp_path, capsys):
    """A source's own settings add to the general ones; the command line wins; aliases name destinations."""
    general, local = {"ignore": ["*.a"], "aliases": {"x": "/1", "y": "/2"}, "algorithm": "md5", "copyright": "g"}, {"ignore": ["*.b"], "aliases": {"y": "/3"}, "algorithm": "sha256", "copyright": "l"}
    assert settings.merged(general, local) == {"ignore": ["*.a", "*.b"], "aliases": {"x": "/1", "y": "/3"}, "algorithm": "sha256", "copyright": "l"}
    assert settings.merged(general, local, frozenset(["algorithm"]))["algorithm"] == "md5" and settings.merged({}, {}) == {}
    card, archive = tmp_path / "card", tmp_path / "archive"
    card.mkdir()
    for name in ("a.jpg", "b.tmp", "c.raw"):
        (card / name).write_bytes(JPEG + name.encode())
    (card / settings.LOCAL).write_text(json.dumps({"ignore": ["*.tmp"], "aliases": {"nas": str(archive)}}))
    (tmp_path / "general.json").write_text(json.dumps({"ignore": ["*.raw"], "algorithm": "md5", "camera_owner": "me"}))
    assert cli.main(["--config", str(tmp_path / "general.json"), "sort", "--source", str(card), "--dest", "+nas"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert (out["processed"], out["skipped"]) == (1, 0)
    (name,) = [p.name for p in archive.rglob("*.jpg")]
    assert "-0-" in name and next(archive.rglob("*.xmp")).read_text().count("<aux:OwnerName>me<") == 1
