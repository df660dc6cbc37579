"""Pieces of SQL shared by the oracles of text queries."""

#: White space as Unicode has it; RE2's \s is ASCII only.
SPACE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def clean(column: str) -> str:
    return f"trim(regexp_replace({column}, '{SPACE}+', ' ', 'g'))"


def words(column: str) -> str:
    return f"list_filter(string_split({clean(column)}, ' '), lambda w: w <> '')"


#: Letters beyond ASCII made word characters, so that ASCII word boundaries stand where Unicode ones do.
WIDE = r"[\x{aa}\x{b2}\x{b3}\x{b5}\x{b9}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2c1}\x{300}-\x{374}\x{376}-\x{37d}\x{37f}-\x{1fff}\x{203f}\x{2040}\x{3040}-\x{d7ff}\x{ff10}-\x{ff19}\x{ff21}-\x{ff3a}\x{ff41}-\x{ff5a}]"
