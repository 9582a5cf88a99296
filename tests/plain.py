"""Plain versions of the chunkers, to compare with."""

import re


def sections(text: str) -> list[tuple[str, str]]:
    """(title, body) by headings of levels 1 to 4; empty bodies go; without any the whole text is one."""
    out: list[tuple[str, list[str]]] = [("", [])]
    for line in text.split("\n"):
        if m := re.match(r"^(#{1,4})\s+(.*)$", line):
            out.append((m[2].strip(), []))
        else:
            out[-1][1].append(line)
    rows = [(t, "\n".join(b).strip()) for t, b in out]
    return [r for r in rows if r[1]] or [("", text)]


def packed_sentences(text: str, size: int = 400, overlap: int = 50, least: int = 20) -> list[str]:
    """Sentences packed into chunks of ``size`` characters; longer ones are cut into overlapping windows."""
    out, held = [], ""
    for s in re.split(r"(?<=[.!?])\s+", re.sub(r"\s+", " ", text).strip()):
        if len(s) > size:
            out += [held, *(s[i : i + size] for i in range(0, len(s), size - overlap))]
            held = ""
        elif len(held) + 1 + len(s) <= size:
            held = f"{held} {s}".strip()
        else:
            out.append(held)
            held = s
    return [c for c in [*out, held] if len(c.strip()) > least]


def prose(text: str) -> list[tuple[str, str]]:
    """(section, chunk): the sections' sentences, packed."""
    return [(title, c) for title, body in sections(text) for c in packed_sentences(body)]
