"""Pieces of the DuckDB SQL that the oracles share."""

TOKEN = r"[\x{0980}-\x{09FF}]+|[A-Za-z]+[0-9]*|[0-9]+(?:[.,:/][0-9]+)*"


def norm(c: str) -> str:
    x = f"translate(nfc_normalize({c}), chr(8216)||chr(8217)||chr(8218)||chr(8219)||chr(8220)||chr(8221)||chr(8222)||chr(8223)||chr(8211)||chr(8212)||chr(8213)||chr(8722)||chr(160)||chr(8239)||chr(8199)||chr(8201)||chr(2405)||chr(8203)||chr(8204)||chr(8205)||chr(8288)||chr(65279), '''''''''\"\"\"\"----    '||chr(2404))"
    x = f"replace({x}, chr(8230), '...')"
    x = f"translate({x}, '০১২৩৪৫৬৭৮৯', '0123456789')"
    for p, to in ((r"[ \t\r\f\x0B]+", " "), (r"\n{3,}", "\n\n"), (r"[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]+([।,;:?!)\]}])", r"\1"), (r"([(\[{])\s+", r"\1"), (r"^\s+|\s+$", "")):
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    return x


def match(c: str) -> str:
    x = f"regexp_replace(lower({norm(c)}), '[^\\x{{0980}}-\\x{{09FF}}a-z0-9\\s]', ' ', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def tokens(c: str) -> str:
    return f"regexp_extract_all({norm(c)}, '{TOKEN}')"


def tokens_lower(c: str) -> str:
    return f"regexp_extract_all(lower({norm(c)}), '{TOKEN}')"


def shingles(c: str, n: int = 3) -> str:
    """List of distinct n-word strings of column m (the matching form)."""
    return f"list_transform([string_split({c}, ' ')], lambda w: CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, CAST(len(w) - {n - 2} AS BIGINT)), lambda i: array_to_string(w[i:i+{n - 1}], ' '))) END)[1]"
