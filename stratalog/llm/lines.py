"""Lines and words of a text as SQL fragments."""

#: The six ASCII blanks as a SQL literal; the parser has no escape of its own for a vertical tab or a form feed.
BLANKS = "' \\t\\n\\u000B\\u000C\\r'"
WORD = r"[^\x20\x09-\x0D]+"


def trimmed(line: str) -> str:
    return f"trim(BOTH {BLANKS} FROM {line})"


#: The same for SQL that the queries are held against.
ORACLE_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
