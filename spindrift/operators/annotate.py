"""Domain, type and confidence of chunks; hints, routes and forms of queries.  Cues are our own words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import accent_fold, let

DOMAINS = {
    "science": ("physi", "chemi", "biolog", "energ", "molec", "planet", "cellul"), "technology": ("software", "comput", "network", "reseau", "algorithm", "program", "server"),
    "history": ("empire", "siecle", "century", "war ", "guerre", "revolution", "dynast"), "geography": ("river", "fleuve", "mountain", "montagne", "capital", "ocean", "island"),
    "language": ("grammar", "grammaire", "verb", "syntax", "alphabet", "vowel", "dialect"),
}
COMPARE, DEFINE, EXAMPLE = ("versus", "compar", "differ", "unlike"), ("is a", "defin", "means", "est un"), ("for example", "such as", "par exemple")
GREET, CREATE, REASON = ("hello", "bonjour", "hola", "hallo"), ("write", "imagine", "invent"), ("why", "explain", "pourquoi", "warum")
STAGES = {
    "factual": ["retrieve", "symbolic", "generate"], "reasoning": ["retrieve", "symbolic", "generate"], "creative": ["intent", "generate"],
    "conversation": ["memory", "generate"], "complex": ["memory", "retrieve", "intent", "symbolic", "generate"], "code": ["verify", "generate"],
}


def _folded(text: Column) -> Column:
    """Folding is a large expression, so a text is folded in one place and searched by ``let``."""
    return accent_fold(F.coalesce(text, F.lit("")))


def _hits(text: Column, cues: tuple[str, ...]) -> Column:
    return sum((text.contains(c).cast("int") for c in cues), F.lit(0))


def _counted(text: Column, domains: dict[str, tuple[str, ...]], told: Callable[[dict[str, Column]], Column]) -> Column:
    """What ``told`` makes of the domains' numbers of cues; the text is folded and searched once."""
    counts = lambda t: F.array(*[_hits(t, cues) for cues in domains.values()])
    return let(let(_folded(text), counts), lambda n: told({d: n[i] for i, d in enumerate(domains)}))


def _first(counts: dict[str, Column], top: Column) -> Column:
    return F.coalesce(*[F.when(c == top, d) for d, c in counts.items()])


def domain(filename: Column, text: Column, domains: dict[str, tuple[str, ...]] = DOMAINS) -> Column:
    """A domain named by the file, else the one with most keywords if two at least (the first on ties), else ``general``."""
    named = F.coalesce(*[F.when(F.lower(filename).contains(d), d) for d in domains])

    def most(counts: dict[str, Column]) -> Column:
        top = F.greatest(*counts.values())
        return F.when(top >= 2, _first(counts, top))

    return F.coalesce(named, _counted(text, domains, most), F.lit("general"))


def domain_hint(query: Column, domains: dict[str, tuple[str, ...]] = DOMAINS) -> Column:
    """The domain with strictly most keywords, else null."""

    def only(counts: dict[str, Column]) -> Column:
        top = F.greatest(*counts.values())
        ties = sum(((c == top).cast("int") for c in counts.values()), F.lit(0))
        return F.when((top > 0) & (ties == 1), _first(counts, top))

    return _counted(query, domains, only)


def chunk_type(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(_hits(t, COMPARE) >= 2, "comparison").when(_hits(t, DEFINE) > 0, "definition").when(_hits(t, EXAMPLE) > 0, "example").when(F.length(t) > 200, "explanation").otherwise("fact")


def confidence(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    heads = F.size(F.regexp_extract_all(t, F.lit(r"(?m)^#{1,6} "), F.lit(0)))
    n = F.length(t)
    score = F.lit(0.5) + F.when(heads >= 3, 0.2).when(heads >= 1, 0.1).otherwise(0.0) + F.when((n > 500) & (n < 10000), 0.1).otherwise(0.0) + F.when(~t.contains("```"), 0.05).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), score), 6)


def structure(query: Column) -> Column:
    q = F.lower(query)
    return F.when(_hits(q, COMPARE) > 0, "comparison").when(_hits(q, REASON) > 0, "explanation").when(q.contains("analy"), "analysis").otherwise("explanation")


def query_type(query: Column, label: Column | None = None, sure: Column | None = None) -> Column:
    """Code fences first, then a sure classifier, then cues."""
    head = F.when(query.contains("```"), "code")
    if label is not None:
        head = head.when((sure >= 0.5) & label.isin(*STAGES), label)

    def cued(q: Column) -> Column:
        asks = q.contains("?") | (_hits(q, ("what", "who", "when", "where", "quel", "qui ", "wer ", "wo ")) > 0)
        return F.when(_hits(q, GREET) > 0, "conversation").when(_hits(q, CREATE) > 0, "creative").when(_hits(q, REASON) > 0, "reasoning").when(asks, "factual").otherwise("conversation")

    return head.otherwise(let(_folded(query), cued))


def routed(query: Column, label: Column | None = None, sure: Column | None = None, domains: dict[str, tuple[str, ...]] = DOMAINS) -> Column:
    """struct(kind, stages, domain, reason): a code fence sets the domain code, a greeting none."""
    kind = query_type(query, label, sure)
    fenced, greets = F.coalesce(query.contains("```"), F.lit(False)), let(_folded(query), lambda q: _hits(q, GREET)) > 0
    learned = (sure >= 0.5) & label.isin(*STAGES) if label is not None else F.lit(False)
    hint = F.when(fenced, "code").when(greets & ~F.coalesce(learned, F.lit(False)), F.lit(None)).otherwise(domain_hint(query, domains))
    reason = F.when(fenced, "code fence").when(learned, "classifier").otherwise("cues")
    return let(kind, lambda k: F.struct(k.alias("kind"), stages(k).alias("stages"), hint.alias("domain"), reason.alias("reason")))


def stages(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.array(*map(F.lit, v))) for k, v in STAGES.items()])


def comparison_pair(query: Column) -> Column:
    patterns = (r"(?iu)between (.+?) and (.+?)\s*\??$", r"(?iu)compare (.+?) (?:and|with|to) (.+?)\s*\??$", r"(?iu)^(.+?) versus (.+?)\s*\??$")
    pick = lambda p: F.when(query.rlike(p), F.struct(no_article(F.regexp_extract(query, p, 1)).alias("a"), no_article(F.regexp_extract(query, p, 2)).alias("b")))
    return F.coalesce(*map(pick, patterns))


def definition_entity(query: Column) -> Column:
    patterns = (r"(?iu)what (?:is|are) (.+?)\s*\??$", r"(?iu)define (.+?)\s*\??$", r"(?iu)definition of (.+?)\s*\??$", r"(?iu)who (?:is|was) (.+?)\s*\??$", r"(?iu)qu'est-ce que? (.+?)\s*\??$")
    return F.coalesce(*[F.when(query.rlike(p), no_article(F.regexp_extract(query, p, 1))) for p in patterns])


def no_article(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(label), r"(?iu)^(?:the|an?|le|la|les|un|une|des|der|die|das|el|los)\s+|^l['’]", ""))
