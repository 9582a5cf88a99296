"""Chunkers.  Sections and sentences are split and packed by expressions; the code-aware packing is sequential over lines and goes through Arrow batches.  Texts stay where they are."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.text import let

#: The characters of white space; BLANK is a pattern of those within a line.
_WIDE = ((0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
_class = lambda ranges: "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)
BLANK = _class(((9, 9), (11, 13), *_WIDE))
SPACE = "".join(chr(c) for a, b in ((9, 13), *_WIDE) for c in range(a, b + 1))
ANY_HEAD = re.compile(r"^#{1,6}\s+(.*)$")
UNDERLINE = re.compile(r"=+|-+|~+|\^+")


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def sections(text: Column) -> Column:
    """array<struct<section, body>> by headings of levels 1 to 4; empty bodies go; without any the whole text is one."""
    mark = rf"#{{1,4}}[{BLANK}]"

    def section(part: Column) -> Column:
        headed = F.rlike(part, F.lit(rf"\A{mark}"))
        title = F.when(headed, _strip(F.regexp_extract(part, r"\A#{1,4}([^\n]*)", 1))).otherwise("")
        return F.struct(title.alias("section"), _strip(F.when(headed, F.regexp_replace(part, r"\A[^\n]*\n?", "")).otherwise(part)).alias("body"))

    whole = lambda body: F.array(F.struct(F.lit("").alias("section"), F.when(body != "", body).otherwise(text).alias("body")))
    found = F.filter(F.transform(F.split(text, rf"(?dm)(?=^{mark})"), section), lambda x: x["body"] != "")
    return F.when(~F.contains(text, F.lit("#")), let(_strip(text), whole)).otherwise(let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(whole(F.lit("")))))


def packed_sentences(text: Column, size: int = 400, overlap: int = 50, least: int = 20) -> Column:
    """array<string>: sentences packed into chunks of ``size`` characters; longer ones are cut into overlapping windows; chunks of ``least`` or fewer go.

    One fold over the sentences that holds the open chunk and the closed ones.
    """
    flat = F.trim(F.regexp_replace(text, r"(?U)(?! [^\s\x1C-\x1F])[\s\x1C-\x1F]+", " "))  # the same characters as SPACE; single blanks stay as they are
    none = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def step(acc: Column, s: Column) -> Column:
        out, held, n = acc["out"], acc["held"], F.length(s)
        state = lambda closed, kept: F.struct(closed.alias("out"), kept.alias("held"))
        windows = F.transform(F.sequence(F.lit(0), n - 1, F.lit(size - overlap)), lambda i: F.substring(s, i + 1, F.lit(size)))
        fits = F.length(held) + 1 + n <= size
        return F.when(n > size, state(F.concat(out, F.array(held), windows), F.lit(""))).when(fits, state(out, F.trim(F.concat(held, F.lit(" "), s)))).otherwise(state(F.concat(out, F.array(held)), s))

    closed = F.aggregate(F.split(flat, "(?<=[.!?]) "), none, step, lambda acc: F.concat(acc["out"], F.array(acc["held"])))
    return F.filter(closed, lambda c: F.length(F.trim(c)) > least)


def prose(text: Column) -> Column:
    """array<struct<section, chunk>>: the sections' sentences, packed."""
    own = lambda x: F.transform(packed_sentences(x["body"]), lambda c: F.struct(x["section"].alias("section"), c.alias("chunk")))
    return F.flatten(F.transform(sections(text), own))


def units(text: str, markdown: bool = True) -> list[tuple[str, str]]:
    """(section, block): blocks between blank lines; fences hold together; sections begin at underlined titles and, in markdown, at headings."""
    out: list[tuple[str, str]] = []
    section, block, fence = "", [], ""

    def close() -> None:
        if block:
            out.append((section, "\n".join(block)))
            block.clear()

    for line in text.split("\n"):
        mark = line.strip()[:3]
        under = not fence and block and UNDERLINE.fullmatch(line.strip()) and len(line.strip()) >= max(3, len(block[-1].strip()) / 2)
        if fence or mark in ("```", "~~~") and not under:
            block.append(line)
            fence = "" if fence and mark == fence else fence or mark
        elif markdown and (m := ANY_HEAD.match(line)):
            close()
            section = m[1].strip()
        elif under:
            title = block.pop().strip()  # a paragraph may end right before it
            close()
            section = title
        elif not line.strip():
            close()
        else:
            block.append(line)
    close()
    return out


def code_chunks(text: str, most: int = 1500, least: int = 40, markdown: bool = True) -> list[tuple[str, str]]:
    """(section, chunk): whole blocks, packed with a blank line between, never over sections; oversize blocks are cut at lines."""
    out: list[tuple[str, str]] = []
    for name, body in units(text, markdown):
        parts, held = [], ""
        for line in body.split("\n") if len(body) > most else [body]:
            if held and len(held) + 1 + len(line) > most:
                parts.append(held)
                held = line
            else:
                held = f"{held}\n{line}" if held else line
        for p in [*parts, held]:
            if out and out[-1][0] == name and len(out[-1][1]) + 2 + len(p) <= most:
                out[-1] = (name, f"{out[-1][1]}\n\n{p}")
            else:
                out.append((name, p))
    return [(n, c) for n, c in out if len(c.strip()) >= least]


def message_parts(text: str, limit: int = 4000) -> list[str]:
    out = []
    while len(text) > limit:
        cut = text.rfind("\n", 0, limit)
        cut = cut if cut > limit // 2 else limit
        out.append(text[:cut])
        text = text[cut:].lstrip()
    return [*out, text]


@udtf(returnType="part int, text string")
class MessageParts:
    """``message_parts`` as a table function: (part, text)."""

    def eval(self, text: str, limit: int):
        yield from enumerate(message_parts(text or "", limit))


def chunked(docs: DataFrame, split: Callable[[str], list], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, section, chunk) by a splitter that gives chunks or (section, chunk) pairs; null text gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, c in enumerate(split(text)):
                    rows.append((name, i, *(("", c) if isinstance(c, str) else c)))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["doc_id", "chunk_index", "section", "chunk"])

    return docs.select(F.col(id_col).cast("long"), text_col).filter(F.col(text_col).isNotNull()).mapInArrow(run, "doc_id long, chunk_index int, section string, chunk string")


def exploded(docs: DataFrame, parts: Column, *keep: str) -> DataFrame:
    """(*keep, chunk_index, section, chunk) by an expression that gives chunks, (section, chunk) or (section, body) pairs; null gives none."""
    pair = docs.select(parts.alias("p")).schema["p"].dataType.elementType
    rows = docs.select(*keep, F.posexplode(parts).alias("chunk_index", "_part"))
    named = pair.typeName() == "struct"
    return rows.select(*keep, "chunk_index", *([F.col("_part.section"), F.col(f"_part.{pair.names[1]}").alias("chunk")] if named else [F.lit("").alias("section"), F.col("_part").alias("chunk")]))
