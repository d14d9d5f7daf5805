"""CRC-32 as a DuckDB expression, for the SQL of queries that hash text."""

from __future__ import annotations


def _table() -> list[int]:
    """CRC-32 of each half byte by the reflected polynomial 0xEDB88320."""
    out = []
    for crc in range(16):
        for _ in range(4):
            crc = 0xEDB88320 ^ (crc >> 1) if crc & 1 else crc >> 1
        out.append(crc)
    return out


def digits_sql(hexadecimal: str) -> str:
    """The digits of a hexadecimal string as a list of integers."""
    return f"list_transform(string_split(upper({hexadecimal}), ''), lambda d: (strpos('0123456789ABCDEF', d) - 1)::BIGINT)"


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text that is not empty: half a byte at a time, the lower half first."""
    halves = digits_sql(f"regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g')")
    table = f"[{', '.join(map(str, _table()))}]::BIGINT[]"
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {halves}), "
        f"lambda c, d: xor(c >> 4, ({table})[(xor(c, d) & 15) + 1])))"
    )
