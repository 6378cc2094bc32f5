"""Secret scans through a trigram inverted index.

From each rule's regular expression follows a Boolean query over trigrams: an
AND of ORs of trigram sets that any match must contain. The index holds, for
the trigrams that some query asks for, the ids of the documents whose
lower-cased text contains them. Intersecting the postings gives each rule's
candidate documents, and only those are verified with the expression itself.
A rule without mandatory trigrams scans every text.

All of it is DataFrame expressions. Spans are code points, end exclusive.

Defined cases: a null or empty text has no secrets; a null id is an id like
any other; rows that share an id share their candidates and are verified each;
an empty table gives no rows; the input's other columns are ignored by
``scan`` and kept by ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise

MAX_STRINGS = 64
MAX_CLASS = 8
#: Matches that are placed in one fold.
RUN = 256


@dataclass(frozen=True)
class Rule:
    """``group`` must have at least ``least`` characters, or the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + MORE


# ---------------------------------------------------------------- the queries


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[k: k + 3] for k in range(len(text) - 2))


def _absorb(sets) -> frozenset[frozenset[str]]:
    """An OR of ANDs without the ANDs that another one implies."""
    return frozenset(s for s in sets if not any(t < s for t in sets))


def _require(strings: set[str]) -> list[frozenset]:
    """What the presence of one of the strings requires: nothing, or one OR of ANDs."""
    options = [trigrams(s) for s in strings]
    return [_absorb(options)] if all(options) else []


def _walk(nodes) -> tuple[set[str] | None, list[frozenset]]:
    """``(strings, requirements)``: all texts the nodes can match, or None when
    they are too many, and the ORs of ANDs that any match must satisfy."""
    exact: set[str] = {""}
    whole, needs = True, []

    def end():
        nonlocal exact, whole
        needs.extend(_require(exact))
        exact, whole = {""}, False

    for op, arg in nodes:
        strings: set[str] | None = None
        inner: list[frozenset] = []
        if op is C.LITERAL:
            strings = {chr(arg).lower()}
        elif op is C.IN:
            found = set()
            for kind, value in arg:
                if kind is C.LITERAL:
                    found.add(chr(value).lower())
                elif kind is C.RANGE and value[1] - value[0] < MAX_CLASS:
                    found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    found |= {str(k) for k in range(100)}
            strings = found if len(found) <= MAX_CLASS else None
        elif op is C.SUBPATTERN:
            strings, inner = _walk(arg[3])
        elif op is C.BRANCH:
            parts = [_walk(p) for p in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            elif all(n for _, n in parts):
                inner = [_absorb(set().union(*(n[0] for _, n in parts)))]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, sub = arg
            one, part = _walk(sub)
            if one is not None and most <= 3 and len(one) ** most <= MAX_STRINGS:
                strings, grown = set(), {""}
                for k in range(most + 1):
                    if k >= least:
                        strings |= grown
                    grown = {a + b for a in grown for b in one}
            elif least:
                inner = part if one is None else _require(one)
        if strings is not None and len(exact) * len(strings) <= MAX_STRINGS:
            exact = {a + b for a in exact for b in strings}
        else:
            end()
            if strings is not None:
                exact = strings
            needs.extend(inner)
    if whole:
        return exact, []
    needs.extend(_require(exact))
    return None, needs


def query_of(pattern: str) -> list[frozenset[frozenset[str]]]:
    """The trigram query of an expression: an AND of ORs of ANDs; empty means scan all."""
    strings, needs = _walk(_parser.parse(pattern))
    return _require(strings) if strings is not None else needs


def index(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings ``trigram, doc_id`` of the trigrams that the rules' queries ask for."""
    wanted = sorted({t for r in rules for need in query_of(r.pattern) for s in need for t in s})
    low = F.lower(F.col(text_col))
    found = F.filter(F.array(*map(F.lit, wanted)), lambda t: F.contains(F.col("__low"), t))
    rows = docs.select(F.col(id_col).alias("doc_id"), low.alias("__low")).where("__low IS NOT NULL")
    return rows.select(F.explode(found).alias("trigram"), "doc_id")


def candidates(postings: DataFrame, rules=RULES) -> DataFrame:
    """``doc_id, kinds``: the rules whose queries a document's postings satisfy."""
    held = postings.groupBy("doc_id").agg(F.collect_set("trigram").alias("t"))
    kinds = []
    for r in rules:
        ok = F.lit(True)
        needs = query_of(r.pattern)
        for need in needs:
            any_of = F.lit(False)
            for s in sorted(map(sorted, need)):
                any_of = any_of | (F.size(F.array_intersect("t", F.array(*map(F.lit, s)))) == len(s))
            ok = ok & any_of
        if needs:
            kinds.append(F.when(ok, F.lit(r.kind)))
    return held.select("doc_id", F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


# ---------------------------------------------------------------- verification


def _pieces(text: Column, rule: Rule) -> tuple[Column, Column, Column | None]:
    """What lies between matches (one piece more than matches), the matches, and the lengths that decide where a group tells them."""
    pattern = F.lit(rule.pattern)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else None
    return F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), sizes


def _once(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of ``(start, rank, end, kind)`` of a rule's matches that are long enough.

    A fold that appends copies its list at each match, so matches are placed in
    runs of ``RUN``, each from its own start.
    """
    between, matches, sizes = _pieces(text, rule)
    steps = F.zip_with(between, matches, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("n"), F.length(m).alias("k")))
    if sizes is not None:
        steps = F.zip_with(steps, sizes, lambda s, k: F.struct(s["gap"].alias("gap"), s["n"].alias("n"), k.alias("k")))
    none = F.array().cast("array<struct<start: int, rank: int, end: int, kind: string>>")

    def place(acc, x):  # the piece after the last match has no length and adds nothing
        start = acc["at"] + x["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("rank"), (start + x["n"]).alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct((start + x["n"]).alias("at"), F.when(x["k"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def begin(acc, run):
        length = F.aggregate(run, F.lit(0), lambda total, x: total + F.coalesce(x["gap"] + x["n"], F.lit(0)))
        return F.struct((acc["at"] + length).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def spans(runs):
        starts = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), begin, lambda acc: acc["out"])
        return F.flatten(F.zip_with(runs, starts, lambda run, at: F.aggregate(run, F.struct(at.alias("at"), none.alias("out")), place, lambda acc: acc["out"])))

    def cut(every):
        return F.transform(F.sequence(F.lit(0), F.size(every) - 1, F.lit(RUN)), lambda at: F.slice(every, at + 1, F.lit(RUN)))

    placed = _once(steps, lambda every: _once(cut(every), spans))
    return F.when(F.rlike(text, F.lit(rule.pattern)), placed).otherwise(none)


def _mask(least: int, mask: Column):
    return lambda m, k: F.when(k >= least, mask).otherwise(m)


def _with_kinds(docs: DataFrame, rules, id_col: str, text_col: str, kinds: str) -> DataFrame:
    """The rows with a column ``kinds``, the rules to verify (null: those that scan all)."""
    postings = materialise(index(docs, rules, id_col, text_col), "secret-postings")
    other = free_name(docs.columns, "__id")
    found = candidates(postings, rules).select(F.col("doc_id").alias(other), F.col("kinds").alias(kinds))
    return docs.join(found.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(other)), "left").drop(other)


def _asked(rule: Rule, kinds: str) -> Column:
    if not query_of(rule.pattern):
        return F.lit(True)
    return F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False))


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` (array of ``start, rank, end, kind``, sorted) of each row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = _with_kinds(slim, rules, "doc_id", "text", "kinds")
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start: int, rank: int, end: int, kind: string>>")
    each = [F.when(_asked(r, "kinds"), spans_of(text, r, n)).otherwise(none) for n, r in enumerate(rules)]
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with every secret replaced by ``[REDACTED:kind]``, rule after rule."""
    kinds = free_name(docs.columns, "__kinds")
    rows = _with_kinds(docs, rules, id_col, text_col, kinds)
    for r in rules:
        text = F.col(text_col)
        between, matches, sizes = _pieces(text, r)
        least, mask = r.least, F.lit(f"[REDACTED:{r.kind}]")
        sizes = F.transform(matches, F.length) if sizes is None else sizes
        masked = F.zip_with(matches, sizes, _mask(least, mask))
        joined = F.array_join(F.zip_with(between, masked, lambda b, m: F.concat(F.coalesce(b, F.lit("")), F.coalesce(m, F.lit("")))), "")
        rows = rows.withColumn(text_col, F.when(_asked(r, kinds) & F.rlike(text, F.lit(r.pattern)), joined).otherwise(text))
    return rows.drop(kinds)
