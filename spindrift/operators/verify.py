"""Code verification: Python and HTML by the standard library's parsers, SQL and CSS by small scanners, Bash and JavaScript, where asked for, by their interpreters' syntax checks.  No code is ever run."""

from __future__ import annotations

import ast
import json
import re
import subprocess
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_blocks

#: Names of languages and what checks them.
ALIASES = {"python": "python", "py": "python", "bash": "bash", "sh": "bash", "shell": "bash", "javascript": "javascript", "js": "javascript", "sql": "sql", "html": "html", "htm": "html", "css": "css"}
#: Elements without an end tag, by the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"p", "div", "section", "article", "table", "tr", "ul", "ol", "nav", "header", "footer", "body", "html", "head", "title"}
STATEMENTS = "select|insert|update|delete|create|alter|drop|with|merge"
#: Seconds and error lines of a syntax check in a process of its own; only these checks' lines are cut.
TIMEOUT, ERRORS = 5, 5

Found = tuple[list[str], list[str], dict]  # errors, warnings, structure


def python(code: str) -> Found:
    try:
        tree = ast.parse(code)
    except SyntaxError as e:
        return [f"line {e.lineno or 0}: {e.msg}"], [], {}
    except (ValueError, RecursionError, MemoryError) as e:
        return [f"line 0: {e}"], [], {}
    found: dict = {"imports": [], "functions": [], "classes": [], "main_guard": False, "lines": len(code.splitlines())}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found["imports"] += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            found["imports"].append("." * node.level + (node.module or ""))
        elif isinstance(node, ast.FunctionDef):
            found["functions"].append(node.name)
        elif isinstance(node, ast.AsyncFunctionDef):
            found["functions"].append(f"async {node.name}")
        elif isinstance(node, ast.ClassDef):
            found["classes"].append(node.name)
        elif isinstance(node, ast.If) and isinstance(node.test, ast.Compare) and isinstance(node.test.left, ast.Name):
            found["main_guard"] |= node.test.left.id == "__name__"
    plain = found["lines"] > 5 and not found["functions"] and not found["classes"]
    return [], ["no function or class"] if plain else [], found


def checked_by(command: list[str], code: str) -> list[str]:
    """The first error lines of a syntax check that reads the code from its input; an absent program or one that takes too long is an error."""
    try:
        done = subprocess.run(command, input=code, capture_output=True, text=True, timeout=TIMEOUT)
    except FileNotFoundError:
        return [f"{command[0]} is not installed"]
    except subprocess.TimeoutExpired:
        return [f"{command[0]} took more than {TIMEOUT} s"]
    if not done.returncode:
        return []
    return [line.strip() for line in (done.stderr or done.stdout).splitlines() if line.strip()][:ERRORS] or [f"{command[0]} failed"]


def bash(code: str) -> Found:
    names = [a or b for a, b in re.findall(r"(?m)^\s*(?:function\s+([\w-]+)|([\w-]+)\s*\(\))", code)]
    return checked_by(["bash", "-n"], code), [], {"functions": names, "shebang": code.startswith("#!"), "lines": len(code.splitlines())}


def javascript(code: str) -> Found:
    found = {
        "functions": [a or b for a, b in re.findall(r"\bfunction\s*\*?\s*([\w$]+)|\b(?:const|let|var)\s+([\w$]+)\s*=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*=>|[\w$]+\s*=>)", code)],
        "classes": re.findall(r"\bclass\s+([\w$]+)", code), "imports": [a or b for a, b in re.findall(r"""\bfrom\s*["']([^"']+)["']|\brequire\(\s*["']([^"']+)["']""", code)],
    }
    return checked_by(["node", "--input-type=module", "--check", "-"], code), [], found


def sql(code: str) -> Found:
    bare = re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", " ", code, flags=re.S)
    kinds = Counter(m[1].upper() for s in bare.split(";") if (m := re.match(rf"\s*({STATEMENTS})\b", s, re.I)))
    return [] if kinds else ["no statement"], ["only statement types are checked"], {"statements": dict(sorted(kinds.items()))}


class _Tags(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.open: list[str] = []
        self.errors: list[str] = []
        self.seen: Counter = Counter()

    def handle_starttag(self, tag: str, attrs) -> None:
        self.seen[tag] += 1
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.seen[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self.open and self.open[-1] == tag:
            self.open.pop()
        else:  # what is open stays so
            self.errors.append(f"closes unopened {tag}")


def html(code: str) -> Found:
    tags = _Tags()
    tags.feed(code)
    tags.close()
    flags = {f"has_{t}": t in tags.seen for t in ("html", "head", "body")}
    return tags.errors + [f"leaves {t} open" for t in tags.open], [], {"tags": dict(sorted(tags.seen.items())), **flags}


def css(code: str) -> Found:
    bare = re.sub(r"/\*.*?\*/|\"[^\"]*\"|'[^']*'", " ", code, flags=re.S)
    errors: list[str] = []
    rules, at_rules, depth, begin = 0, [], 0, 0
    holds: list[bool] = []  # of open blocks: whether they hold rules
    for m in re.finditer(r"[{};]", bare):
        head, begin = bare[begin : m.start()].strip(), m.end()
        if m[0] == "{":
            if head.startswith("@"):
                at_rules.append(head[1:].split()[0])
            elif head:
                rules += 1
            else:
                errors.append("a block without a selector")
            holds.append(head.startswith(("@media", "@supports", "@layer", "@keyframes", "@container")))
            depth += 1
            continue
        if not depth and head.startswith("@"):
            at_rules.append(head[1:].split()[0])
        elif head and ":" not in head and not (holds and holds[-1]):
            errors.append(f"no declaration: {head.split()[0]}")
        if m[0] == "}":
            if not depth:
                errors.append("closes unopened block")
            else:
                depth -= 1
                holds.pop()
    errors += ["leaves a block open"] * bool(depth)
    if not rules and not at_rules and not errors:
        errors.append("no rule")
    return errors, [], {"rules": rules, "at_rules": at_rules}


VERIFIERS = {"python": python, "bash": bash, "javascript": javascript, "html": html, "sql": sql, "css": css}
#: Languages that need a process a snippet; only checked where asked for.
OUTSIDE = {"bash", "javascript"}


def verify(language: str | None, code: str | None, outside: bool = False) -> tuple[bool | None, str | None, list[str], list[str], dict]:
    """(valid, language, errors, warnings, structure); valid is null for languages without a verifier; blank code is invalid."""
    name = ALIASES.get((language or "").strip().lower())
    if name is None or name in OUTSIDE and not outside:
        return None, name, [], ["skipped"], {}
    if not (code or "").strip():
        return False, name, ["empty"], [], {}
    errors, warnings, found = VERIFIERS[name](code)
    return not errors, name, errors, warnings, found


RESULT = "id long, language string, valid boolean, errors array<string>, warnings array<string>, structure string"


def verified(rows: DataFrame, id_col: str, language_col: str, code_col: str, outside: bool = False) -> DataFrame:
    """A result for each row; ``structure`` is JSON with sorted keys."""
    texts = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [verify(a, b, outside) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            cols = [pa.array([f[1] for f in found], pa.string()), pa.array([f[0] for f in found], pa.bool_()), pa.array([f[2] for f in found], texts), pa.array([f[3] for f in found], texts), pa.array([json.dumps(f[4], sort_keys=True) for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[f.split()[0] for f in RESULT.split(", ")])

    return rows.select(F.col(id_col).cast("long").alias("id"), language_col, code_col).mapInArrow(run, RESULT)


def verify_stage(queries: DataFrame, blocks: DataFrame | None = None, outside: bool = False) -> DataFrame:
    """(query_id, n_blocks, n_checked, n_valid, n_skipped, all_valid, confidence, errors) of every query (query_id, text).

    ``blocks`` (query_id, lang, code) are explicit ones; without them the fenced
    blocks of the text are taken.  Skipped languages leave ``all_valid`` true; the
    confidence is the share of valid ones among the checked, 0 without any.
    """
    if blocks is None:
        blocks = queries.select("query_id", F.inline(code_blocks(F.coalesce("text", F.lit("")))))
    done = verified(blocks, "query_id", "lang", "code", outside)
    told = done.groupBy(F.col("id").alias("query_id")).agg(
        F.count(F.lit(1)).alias("n_blocks"), F.count("valid").alias("n_checked"), F.count(F.when(F.col("valid"), 1)).alias("n_valid"),
        F.array_sort(F.flatten(F.collect_list(F.when(~F.col("valid"), F.col("errors"))))).alias("errors"),  # one query's blocks
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = queries.select("query_id").join(told, "query_id", "left").select("query_id", *[zero(F.col(c)).alias(c) for c in ("n_blocks", "n_checked", "n_valid")], F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))
    share = F.when(F.col("n_checked") > 0, F.col("n_valid") / F.col("n_checked")).otherwise(0.0)
    return out.select("query_id", "n_blocks", "n_checked", "n_valid", (F.col("n_blocks") - F.col("n_checked")).alias("n_skipped"), (F.col("n_valid") == F.col("n_checked")).alias("all_valid"), share.alias("confidence"), "errors")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.pre = 0
        self.skip: str | None = None  # the element being skipped, and how many of its kind are open
        self.depth = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.skip:
            self.depth += tag == self.skip
            return
        marked = {"navheader", "navfooter"} & set((dict(attrs).get("class") or "").split())
        if tag not in VOID and (tag in ("script", "style") or marked):
            self.skip, self.depth = tag, 1
            self.out.append("\n" if tag in BLOCK else "")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n```\n")
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br" or tag in BLOCK:
            self.out.append("\n")

    def handle_startendtag(self, tag: str, attrs) -> None:
        if not self.skip and (tag == "br" or tag in BLOCK):
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            self.depth -= tag == self.skip
            self.skip = self.skip if self.depth else None
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n")
        elif tag in ("td", "th"):
            self.out.append("  ")
        elif tag in BLOCK or re.fullmatch("h[1-6]", tag):
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"[ \t\r\n]+", " ", data))


def html_text(code: str) -> str:
    """Headings, lists, fences and paragraphs of a page as markdown; an element that is skipped ends with its own end tag only."""
    p = _Text()
    p.feed(code)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(p.out)).strip()


def html_texts(rows: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, text) of every row; null pages are empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([html_text(x or "") for x in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), html_col).mapInArrow(run, f"id {kind}, text string")
