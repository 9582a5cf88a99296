"""Secret scans with a battery of randomness tests (operator 10), in built-in functions only.

Base kinds are patterns.  Spark gives the texts of matches but not their places,
so places are summed up from the lengths of what lies between matches.

The method adds ``random`` spans.  Candidates are runs of ``MIN_RANDOM`` or more
characters of encodings that hold a digit and a letter and touch no base span.
The smallest alphabet that holds all their characters is the encoding inferred:
hexadecimal, base 32, letters of one case with digits, or base 64.  Three tests
ask whether the characters look drawn evenly and independently from it:
chi-squared for uniformity, runs above and below the alphabet's middle, and
lag-1 serial correlation.  The candidate's p-value is that of the least of the
three, 1 - (1 - p)**3, evenly distributed for drawn strings; ordinary identifiers
get small ones.  A report is a discovery of a drawn string, a false one if the
string is ordinary.  Within each class of lengths (log2), over all candidates of
the table, those with p-values over ``SURE`` estimate how many are drawn
(Storey's estimate), so whatever lies above a limit beyond that even share is
taken for false; the limit is the lowest at which the share of false ones among
the reported is ``RATE`` or less, and never above ``SURE``.  The rule needs only
counts of p-values in bins of a tenth of a decade, a small table.

Defined results: null text is an empty one; repeated rows are scanned each; an
empty table gives no rows; columns beyond the two named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .quality import let

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
MIN_RANDOM, RATE, BINS, CHUNK = 20, 0.05, 300, 512
#: p-values over 10 ** (-SURE / 10) are taken for those of drawn strings.
SURE = 13
RANDOM = "[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_RANDOM
KINDS = ("assign", "access", "hex", "random")
#: name, pattern of the whole, characters in order
ALPHABETS = (
    ("hex", "[0-9a-f]+|[0-9A-F]+", "0123456789abcdef"),
    ("base32", "[A-Z2-7]+", "abcdefghijklmnopqrstuvwxyz234567"),
    ("alnum", "[0-9a-z]+|[0-9A-Z]+", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", ".*", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sum(x: str) -> str:
    return f"aggregate({x}, 0L, (a, v) -> a + v)"


def _places(pattern: str, last: str | None = None) -> str:
    """Array of (s, e, m[, g]) of the pattern's matches in ``t``: start, end, match and last group."""
    p = _quoted(pattern)
    base = let(f"transform(sequence(0, (size(x) - 1) div {CHUNK}), j -> {_sum(f'slice(x, 1, j * {CHUNK})')})", "base",
               f"transform(m, (w, i) -> base[i div {CHUNK}] + {_sum(f'slice(x, (i div {CHUNK}) * {CHUNK} + 1, i % {CHUNK})')} + length(gap[i]))")
    one = f"struct(at[i] AS s, at[i] + length(w) AS e, w AS m{', g[i] AS g' if last else ''})"
    found = let(base, "at", f"transform(m, (w, i) -> {one})")
    found = let("transform(m, (w, i) -> cast(length(gap[i]) + length(w) AS bigint))", "x", found)
    if last:
        found = let(f"regexp_extract_all(t, {p}, {last})", "g", found)
    found = let(f"split(t, {p}, -1)", "gap", found)
    kind = "array<struct<s:bigint,e:bigint,m:string" + (",g:string>>" if last else ">>")
    return f"if(t RLIKE {p}, cast({let(f'regexp_extract_all(t, {p}, 0)', 'm', found)} AS {kind}), cast(array() AS {kind}))"


def _tail(z: str) -> str:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    t = f"(1 / (1 + 0.2316419D * abs({z})))"
    poly = f"{t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D))))"
    phi = f"0.3989422804014327D * exp(-{z} * {z} / 2) * {poly}"
    return f"if({z} >= 0, {phi}, 1 - {phi})"


def _p_value() -> str:
    """The battery on ``w``, in characters ``v`` (their places in an alphabet of ``size``) and length ``n``."""
    same = let("sort_array(v)", "u", "aggregate(u, named_struct('prev', -1, 'run', 0L, 'sum', 0L), (a, y) -> if(y = a.prev, named_struct('prev', y, 'run', a.run + 1, 'sum', a.sum + 2 * a.run + 1), named_struct('prev', y, 'run', 1L, 'sum', a.sum + 1)), a -> a.sum)")
    chi = f"size * cast({same} AS double) / n - n"
    df = "(size - 1D)"
    z_chi = let(chi, "c", f"(power(greatest(c, 0D) / {df}, 1D / 3) - (1 - 2 / (9 * {df}))) / sqrt(2 / (9 * {df}))")
    high = "transform(v, y -> if(2 * y >= size, 1L, 0L))"
    runs = f"1 + {_sum('transform(b, (y, i) -> if(i > 0 AND get(b, i - 1) <> y, 1L, 0L))')}"
    z_runs = let(high, "b", let(f"cast({_sum('b')} AS double)", "k", let("2 * k * (n - k) / n + 1", "mu", f"if(mu <= 2, 40D, ({runs} - mu) / sqrt((mu - 1) * (mu - 2) / (n - 1)))")))
    mean = f"{_sum('transform(v, y -> cast(y AS bigint))')} / cast(n AS double)"
    total = lambda x: f"aggregate({x}, 0D, (a, y) -> a + y)"
    serial = let(mean, "mean", let(f"{total('transform(v, y -> (y - mean) * (y - mean))')}", "var", f"if(var = 0, 40D, sqrt(n) * {total('transform(v, (y, i) -> coalesce((y - mean) * (get(v, i - 1) - mean), 0D))')} / var)"))
    return let(z_chi, "zc", let(z_runs, "zr", let(serial, "zs", let(f"least(1D, {_tail('zc')}, 2 * {let('abs(zr)', 'a', _tail('a'))}, 2 * {let('abs(zs)', 'a', _tail('a'))})", "p", "if(p < 1e-6, 3 * p, 1 - power(1 - p, 3))"))))


def _tests() -> str:
    """(s, e, class of length, bin of the p-value) of a candidate ``c``."""
    core = "translate(rtrim('=', c.m), '-_', '+/')"
    pick = "CASE " + " ".join(f"WHEN w RLIKE '^({p})$' THEN '{a}'" for _, p, a in ALPHABETS) + " END"
    fold = f"if(alphabet = '{ALPHABETS[-1][2]}', w, lower(w))"
    value = let(core, "w", let(pick, "alphabet", let("length(alphabet)", "size", let("length(w)", "n", let(f"transform(filter(split({fold}, ''), y -> y <> ''), y -> instr(alphabet, y) - 1)", "v", _p_value())))))
    return f"named_struct('s', c.s, 'e', c.e, 'len', cast(floor(log2(c.e - c.s)) AS int), 'bin', {let(value, 'p', f'cast(least({BINS}, floor(-10 * log10(greatest(p, 1e-300)))) AS int)')})"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base spans and tested candidates of each row; the text is gone from here on."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    found = rows.select(
        "doc_id",
        F.expr(f"filter({_places(ASSIGN, '2')}, x -> length(x.g) >= 8)").alias("assign"),
        F.expr(_places(ACCESS)).alias("access"), F.expr(_places(HEX)).alias("hex"),
        F.expr(f"filter({_places(RANDOM)}, x -> x.m RLIKE '[0-9]' AND x.m RLIKE '[A-Za-z]')").alias("other"),
    )
    spans = [f"transform({k}, x -> named_struct('s', x.s, 'kind', {i}, 'e', x.e))" for i, k in enumerate(KINDS[:3])]
    found = found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.expr(f"sort_array(concat({', '.join(spans)}))").alias("base"), "other")
    free = "filter(other, c -> NOT exists(base, b -> b.s < c.e AND c.s < b.e))"
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.expr(f"transform({free}, c -> {_tests()})").alias("tested"))


def limits(found: DataFrame, rate: float = RATE) -> dict[int, int]:
    """The highest bin reported in each class of lengths (bins go up as p-values go down)."""
    counts = found.select(F.explode("tested").alias("c")).groupBy("c.len", "c.bin").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("len")  # no more rows than bins
    ranked = counts.select("len", "bin", F.sum("n").over(group.orderBy("bin")).alias("reported"), F.sum(F.when(F.col("bin") < SURE, F.col("n")).otherwise(0)).over(group).alias("sure"))
    drawn = f"sure * (1 - power(10D, -(bin + 1) / 10D)) / (1 - power(10D, -{SURE} / 10D))"  # as many would lie above the bin
    rows = ranked.filter(f"bin >= {SURE} AND reported - {drawn} <= {rate} * reported").groupBy("len").agg(F.max("bin").alias("bin")).collect()
    return {r.len: r.bin for r in rows}


def scan(docs: DataFrame, *, rate: float = RATE, **columns: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    found = common.written(candidates(docs, **columns), "secrets")
    upto = limits(found, rate)
    most = "CASE c.len " + " ".join(f"WHEN {k} THEN {v}" for k, v in upto.items()) + f" ELSE {SURE - 1} END" if upto else str(SURE - 1)
    random = f"transform(filter(tested, c -> c.bin <= {most}), c -> named_struct('s', c.s, 'kind', 3, 'e', c.e))"
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    joined = lambda x: f"array_join(transform({x}, x -> concat_ws(':', {names}[x.kind], x.s, x.e)), ',')"
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.expr(f"sha2({joined('base')}, 256)").alias("base_sha256"), F.expr(joined(f"sort_array(concat(base, {random}))")).alias("spans"))
