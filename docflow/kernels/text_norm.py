"""White space in plain Python, for kernels that end in normalised text."""

from __future__ import annotations

# Unicode's White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def utrim(text: str) -> str:
    return text.strip(WHITE_SPACE)


def normalize_whitespace(text: str) -> str:
    """Lines trimmed, runs of blank lines made one, the whole trimmed."""
    kept: list[str] = []
    for line in map(utrim, text.split("\n")):
        if line or not kept or kept[-1]:
            kept.append(line)
    return utrim("\n".join(kept))
