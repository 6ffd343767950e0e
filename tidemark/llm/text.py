"""SQL for words and shingles, shared by the operators on texts."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"r'[\x20\x09-\x0D]+'"
NO_WORD = r"r'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def lowered(text: str) -> str:
    """The text with A-Z, and nothing else, in lower case; null becomes empty."""
    text = f"coalesce({text}, '')"
    return f"if(octet_length({text}) = length({text}), lower({text}), translate({text}, '{UPPER}', '{LOWER}'))"


def words(text: str, gap: str = SPACE) -> str:
    """Array of the lower-cased words between gaps."""
    return f"array_remove(split({lowered(text)}, {gap}), '')"


def shingles(w: str, k: int = 5) -> str:
    """Distinct hashes of all ``k`` words in a row; fewer words are one shingle, none are none."""
    gram = ", ".join(f"{w}[i + {j}]" for j in range(k))
    return (
        f"case when size({w}) = 0 then array() when size({w}) < {k} then array(xxhash64({w})) "
        f"else array_distinct(transform(sequence(0, size({w}) - {k}), i -> xxhash64({gram}))) end"
    )
