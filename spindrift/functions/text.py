"""Text expressions, Column to Column, all built-in functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own word lists, for the four languages of the test corpus.
STOP_SEARCH = ("the", "and", "for", "that", "with", "les", "des", "une", "que", "qui", "est", "der", "die", "das", "und", "ist", "los", "las", "por", "con")
STOP_GATE = (*STOP_SEARCH, "what", "which", "quel", "quelle", "comment", "how", "wie", "was", "como", "cual")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Private characters that stand for letters whose fold is longer than one character.
_MARKS = 0xF0000


@cache
def _folds() -> tuple[str, str, str]:
    """(letters, one character for each of the first of them, lines): compatibility forms without combining marks, of all letters that differ from theirs.

    Letters beyond the characters have none.  The n-th letter whose fold is
    longer has the n-th private character, and its fold is the n-th line.
    """
    import unicodedata

    kept, gone, lines = {}, [], []
    for code in range(0x80, 0x110000):
        c = chr(code)
        if 0xD800 <= code < 0xE000 or (fold := "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))) == c:
            continue
        if not fold:
            gone.append(c)
        elif len(fold) == 1:
            kept[c] = fold
        else:
            kept[c] = chr(_MARKS + len(lines))
            lines.append(fold)
    return "".join([*kept, *gone]), "".join(kept.values()), "\n".join(lines)


def accent_fold(text: Column) -> Column:
    """Lower case, compatibility forms and no combining marks, for every script.

    One pass maps letter to letter; letters with a longer fold become private
    characters there, and only texts with such are taken apart.
    """
    letters, folds, lines = _folds()
    longer, n = F.split(F.lit(lines), "\n"), lines.count("\n")
    private = rf"[\x{{{_MARKS:X}}}-\x{{{_MARKS + n:X}}}]"
    mapped = lambda c: F.translate(c, letters, folds)
    marked = lambda c: (c >= chr(_MARKS)) & (c <= chr(_MARKS + n))
    told = lambda c: F.when(marked(c), F.element_at(longer, F.ascii(c) - _MARKS + 1)).otherwise(c)
    each = lambda t, f: F.array_join(F.transform(F.split(t, ""), f), "")
    whole = lambda m: F.when(F.rlike(m, F.lit(private)), each(m, told)).otherwise(m)
    own = lambda c: F.when(marked(c), c).otherwise(let(mapped(c), told))
    return let(F.lower(text), lambda low: F.when(~F.rlike(low, F.lit(r"[^\x00-\x7F]")), low).when(F.rlike(low, F.lit(private)), each(low, own)).otherwise(let(mapped(low), whole)))


def tokens(text: Column, stop: tuple[str, ...] = STOP_SEARCH) -> Column:
    """The set of significant tokens: folded runs of letters and digits longer than two, but stop words."""
    runs = F.regexp_extract_all(accent_fold(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_except(F.filter(runs, lambda t: F.length(t) > 2), F.array(*map(F.lit, stop))))


def slug(label: Column) -> Column:
    s = F.regexp_replace(accent_fold(F.coalesce(label, F.lit(""))), "[^a-z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return let(s, lambda v: F.when(v == "", "unknown").otherwise(v))  # a lambda's expression is evaluated wherever it is named


def slug_candidates(label: Column) -> Column:
    """The whole label's slug, then each word's, without repeats."""
    words = F.transform(F.split(F.trim(label), r"\s+"), slug)
    return F.array_except(F.array_distinct(F.concat(F.array(slug(label)), words)), F.array(F.lit("unknown")))


def clean_chunk(text: Column) -> Column:
    """For display: no heading marks, sentences for inline headings, single blanks and dots."""
    t = F.regexp_replace(text, r"^\s*#+\s*", "")
    t = F.regexp_replace(t, r"\s*#{2,}\s*", ". ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"\.(\s*\.)+", "."))


def sentences(text: Column) -> Column:
    """Split after ``.!?`` and white space, white space collapsed first."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda s: s != "")


def strict_sentences(text: Column) -> Column:
    """Split only where a capital follows."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=\p{Lu})"), lambda s: F.trim(s)), lambda s: s != "")


def plain_markdown(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?s)```.*?```", " ")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"`([^`]*)`", "$1")
    t = F.regexp_replace(t, r"(?m)^\s{0,3}#{1,6}\s*", "")
    return F.regexp_replace(t, r"(?m)^\s*[-*+]\s+", "")


def bare(text: Column) -> Column:
    """Without white space around it."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def _headed(text: Column) -> tuple[Column, Column]:
    """The title of a YAML head, and the text without the head."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    title = F.regexp_extract(head, r"(?m)^title:[ \t]*(.*?)[ \t]*$", 1)
    return F.regexp_replace(title, r"^([\"'])(.*)\1$", "$2"), F.regexp_replace(text, r"(?s)\A---\n.*?\n---(?:\n|\z)", "")


def web_page(text: Column) -> Column:
    """struct(title, body) of a web-documentation page: lines of macros only go, a cross-reference keeps its first quoted argument in backticks, other macros go."""
    title, body = _headed(text)
    body = F.regexp_replace(body, r"(?m)^[ \t]*(?:\{\{[^}]*\}\}[ \t]*)+$\n?", "")
    body = F.regexp_replace(body, r"\{\{\s*\w+\(\s*[\"']([^\"']+)[\"'][^}]*\}\}", "`$1`")
    body = F.regexp_replace(body, r"\{\{[^}]*\}\}", "")
    return F.struct(F.trim(title).alias("title"), bare(body).alias("body"))


def container_page(text: Column) -> Column:
    """struct(title, body) of a container-documentation page: shortcodes of both kinds go, lines that consist of them with their line end."""
    title, body = _headed(text)
    code = r"\{\{(?:<.*?>|%.*?%)\}\}"
    body = F.regexp_replace(body, rf"(?m)^[ \t]*(?:{code}[ \t]*)+$\n?", "")
    return F.struct(F.trim(title).alias("title"), bare(F.regexp_replace(body, code, "")).alias("body"))


def area_language(area: Column, languages: dict[str, str]) -> Column:
    """The language of a documentation area, the last part of its path; areas without one are named after themselves."""
    name = F.lower(F.substring_index(area, "/", -1))
    return F.coalesce(*[F.when(name == k, v) for k, v in languages.items()], name)


def manual_language(page: Column, languages: dict[str, tuple[str, bool]]) -> Column:
    """The language of a manual page: that of the command of its name, or, where it has subcommands, of the name before a dash; else shell."""
    fits = lambda k, more: (page == k) | F.startswith(page, F.lit(f"{k}-")) if more else page == k
    return F.coalesce(*[F.when(fits(k, more), v) for k, (v, more) in languages.items()], F.lit("shell"))


def canonical_model(name: str, owner: str = "sentence-transformers") -> str:
    """A bare model name gains its owner."""
    return name if "/" in name else f"{owner}/{name}"


def prompt_prefix(model: str, kind: str) -> str:
    """What models of the e5 family want before a text: ``kind`` is query or passage."""
    base = model.rsplit("/", 1)[-1].lower()
    return f"{kind}: " if base.startswith("e5-") or "-e5-" in base else ""


def no_overstrike(text: Column) -> Column:
    return F.regexp_replace(text, ".\x08", "")


def significant_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 4))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda s: s != "")))


def session_id(raw: Column) -> Column:
    s = F.substring(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[^\p{L}\p{N}._-]", ""), 1, 128)
    return F.when(s == "", "default").otherwise(s)


def code_blocks(text: Column) -> Column:
    """array<struct<lang, code>> of fenced blocks."""
    pattern = F.lit(r"(?s)```([A-Za-z0-9_+#-]*)[^\n]*\n(.*?)```")
    return F.transform(F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("a"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("b")), lambda x: F.struct(F.lower(x["a"]).alias("lang"), x["b"].alias("code")))
