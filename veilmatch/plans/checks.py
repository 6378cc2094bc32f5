"""More named queries with SQL twins: corruption, samples and evaluations, hardening, corpora, gates and rules.

Imported after ``queries``, whose tables and SQL pieces they share.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import corrupt, similarity
from ..functions.normalize import normalize
from ..functions.tokens import framed, unpacked
from ..operators import evaluate
from ..sources.corpus import read_corpus, read_voters, result_metrics, voter_records, write_corpus, write_report
from .queries import _FEBRL, _GROUPS, _PEOPLE_POS, AREA, FULL, ID, KEY, LINK, NAMES, NOISY, NORMAL, PEOPLE, _groups, _people_twice, _points, blocked, febrl_entries, febrl_frames, people, query, sql_blob, sql_framed, sql_hmac, sql_positions, table
from .schema import DEFAULT, FAST, HARDENED, HIGH_PRECISION, NAME, BloomConfig, FieldPath, FieldSet, FieldSpec, path
from .session import Session, calibrate_on, run, scored


def sql_digits(key: str, salt: str) -> str:
    return f"substr(sha256(CAST({key} AS VARCHAR) || '|{salt}'), 1, 15)"


def sql_pick(key: str, salt: str, n) -> str:
    return f"(CAST('0x' || {sql_digits(key, salt)} AS BIGINT) % greatest(CAST({n} AS BIGINT), 1))"


# ---------------------------------------------------------------- corruption


def sql_spliced(v: str, at: str, length: str, text: str) -> str:
    return f"(substr({v}, 1, {at}) || {text} || substr({v}, {at} + {length} + 1))"


def sql_typo(v: str, key: str, salt: str) -> str:
    table = corrupt.key_neighbours()
    at = sql_pick(key, salt, f"length({v})")
    old = f"substr({v}, {at} + 1, 1)"
    near = f"list_extract([{', '.join(repr(x) for x in table.values())}], strpos('{''.join(table)}', lower({old})))"
    new = f"substr({near}, {sql_pick(key, f'{salt} key', f'length({near})')} + 1, 1)"
    new = f"CASE WHEN {old} <> lower({old}) THEN upper({new}) ELSE {new} END"
    return f"CASE WHEN {v} = '' OR strpos('{''.join(table)}', lower({old})) = 0 THEN {v} ELSE {sql_spliced(v, at, '1', f'({new})')} END"


def sql_drop_char(v: str, key: str, salt: str) -> str:
    at = sql_pick(key, salt, f"length({v})")
    return f"CASE WHEN length({v}) < 3 THEN {v} ELSE {sql_spliced(v, at, '1', repr(''))} END"


def sql_swap(v: str, key: str, salt: str, pairs) -> str:
    options = ", ".join(f"{{'o': {sql_digits(key, f'{salt} {a}')}, 'at': strpos(lower({v}), '{a}'), 'n': {len(a)}, 'to': '{b}'}}" for a, b in pairs)
    first = f"list_sort(list_filter([{options}], lambda x: x.at > 0))[1]"
    return f"coalesce({sql_spliced(v, f'({first}.at - 1)', f'{first}.n', f'{first}.to')}, {v})"


def sql_operators(v: str, key: str, salts: tuple[str, ...]) -> list[str]:
    """The five operators' SQL, in the order of ``corrupt.OPERATORS``."""
    a, b, c, d, _ = salts
    return [sql_typo(v, key, a), sql_drop_char(v, key, b), sql_swap(v, key, c, corrupt.SOUNDS), sql_swap(v, key, d, corrupt.SHAPES), "CAST(NULL AS VARCHAR)"]


_CORRUPT_NAMES = ("typo", "drop_char", "phonetic", "ocr", "missing")


@query(f"SELECT id, {', '.join(f'{e} AS {n}' for e, n in zip(sql_operators('name', 'id', ('typo', 'drop', 'phonetic', 'ocr', '')), _CORRUPT_NAMES))} FROM ({PEOPLE})")
def corrupt_values(spark, sf):
    p, k, v = people(spark, sf), F.col("id"), F.col("name")
    return p.select("id", *(op(v, k).alias(n) for op, n in zip(corrupt.OPERATORS, _CORRUPT_NAMES)))


_PARTS = {"family": str(path(NAME, "family")), "given": str(path(NAME, "given")), "whole": str(FULL), "area": str(AREA)}


def _sql_corrupt_records() -> str:
    """Two rounds of edits over columns of the parts, in the order of their weights."""
    order = sorted(_PARTS, key=lambda c: list(corrupt.WEIGHTS).index(_PARTS[c]))
    rows = "SELECT c_custkey AS id, c_mktsegment AS given, c_name AS family, c_mktsegment || ' ' || c_name AS whole, n_name AS area FROM customer JOIN nation ON c_nationkey = n_nationkey"
    for k in range(2):
        weight = {c: f"CASE WHEN {c} IS NULL THEN 0 ELSE {corrupt.WEIGHTS[_PARTS[c]]} END" for c in order}
        upto = {c: " + ".join(weight[x] for x in order[: n + 1]) for n, c in enumerate(order)}
        chosen = " ".join(f"WHEN r < {upto[c]} THEN '{c}'" for c in order)
        on = "true" if k == 0 else sql_pick("id", "copy edits", 3) + " = 2"
        rows = f"SELECT *, {sql_pick('id', f'copy field {k}', upto[order[-1]])} AS r, {sql_pick('id', f'copy operator {k}', 5)} AS op FROM ({rows})"
        rows = f"SELECT *, CASE WHEN NOT ({on}) THEN NULL {chosen} END AS p FROM ({rows})"
        rows = f"SELECT *, CASE p {' '.join(f'WHEN {c!r} THEN {c}' for c in order)} END AS v FROM ({rows})"
        edits = " ".join(f"WHEN {n} THEN {e}" for n, e in enumerate(sql_operators("v", "id", (f"copy {k}",) * 5)))
        rows = f"SELECT *, nullif(CASE op {edits} END, '') AS new FROM ({rows})"
        rows = f"SELECT id, {', '.join(f'CASE WHEN p = {c!r} THEN new ELSE {c} END AS {c}' for c in order)} FROM ({rows})"
    return f"SELECT id, family, given, CASE WHEN family IS NOT NULL OR given IS NOT NULL THEN whole END AS whole, area FROM ({rows})"


@query(_sql_corrupt_records())
def corrupt_records(spark, sf):
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    values = {"given": F.col("c_mktsegment"), "family": F.col("c_name"), "whole": F.concat_ws(" ", "c_mktsegment", "c_name"), "area": F.col("n_name")}
    rows = c.select(F.col("c_custkey").alias("id"), F.create_map(*(x for n, v in values.items() for x in (F.lit(_PARTS[n]), v))).alias("record"))
    out = corrupt.corrupt_record(rows, "id")
    return out.select("id", *(F.try_element_at("record", F.lit(p)).alias(n) for n, p in _PARTS.items()))


# ---------------------------------------------------------------- samples of pairs


def _numbered(rows: str, by: str, over: str) -> str:
    """``rows`` with ``k``: their number by a hash's bucket, then by ``by``."""
    return f"SELECT *, row_number() OVER ({over} ORDER BY {sql_pick(by, 'number', evaluate.BUCKETS)}, {by}) - 1 AS k FROM ({rows})"


def sql_negatives(rows: str, want: int, seed: int) -> str:
    """``a, b`` of ``rows`` (``id, canonical_id``), as ``sample_negatives`` draws them."""
    records = _numbered(f"SELECT id AS r, canonical_id AS g FROM ({rows})", "r", "PARTITION BY g")
    groups = _numbered(f"SELECT canonical_id AS g, count(*) AS n FROM ({rows}) GROUP BY canonical_id", "g", "")
    total = f"(SELECT count(DISTINCT canonical_id) FROM ({rows}))"
    draws = f"SELECT i, {sql_pick('i', f'{seed} left group', 'm')} AS p, {sql_pick('i', f'{seed} right group', 'm')} AS q FROM (SELECT unnest(range({100 * want + 1000})) AS i, {total} AS m)"
    chosen = f"""SELECT i, x.r AS x, y.r AS y FROM ({draws}) d JOIN ({groups}) a ON a.k = d.p JOIN ({groups}) b ON b.k = d.q
      JOIN ({records}) x ON x.g = a.g AND x.k = {sql_pick('d.i', f'{seed} left record', 'a.n')} JOIN ({records}) y ON y.g = b.g AND y.k = {sql_pick('d.i', f'{seed} right record', 'b.n')} WHERE d.p <> d.q"""
    return f"SELECT a, b FROM (SELECT least(x, y) AS a, greatest(x, y) AS b, min(i) AS i FROM ({chosen}) GROUP BY 1, 2) ORDER BY i LIMIT {want}"


def sql_positives(rows: str, want: int, seed: int) -> str:
    """``a, b`` of ``rows``, as ``sample_positives`` draws them from more than four times as many pairs."""
    records = _numbered(f"SELECT id AS r, canonical_id AS g FROM ({rows})", "r", "PARTITION BY g")
    each = f"SELECT x.g, x.r AS x, y.r AS y, row_number() OVER (ORDER BY {sql_pick('x.g', 'number', evaluate.BUCKETS)}, x.g, y.k, x.k) - 1 AS number FROM ({records}) x JOIN ({records}) y ON x.g = y.g AND x.k < y.k"
    draws = f"SELECT number, min(i) AS i FROM (SELECT i, {sql_pick('i', f'{seed} pair', f'(SELECT count(*) FROM ({each}))')} AS number FROM (SELECT unnest(range({100 * want + 1000})) AS i)) GROUP BY number ORDER BY i LIMIT {want}"
    return f"SELECT least(x, y) AS a, greatest(x, y) AS b FROM ({each}) JOIN ({draws}) USING (number)"


def sql_all_positives(rows: str) -> str:
    return f"SELECT x.id AS a, y.id AS b FROM ({rows}) x JOIN ({rows}) y ON x.canonical_id = y.canonical_id AND x.id < y.id"


_KINDS = "SELECT p_partkey AS id, p_brand || '/' || p_size AS canonical_id FROM part"


def _kinds(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_brand", "p_size").alias("canonical_id"))


@query(sql_negatives(_GROUPS, 200, 7))
def negative_pairs(spark, sf):
    return evaluate.sample_negatives(_groups(spark, sf), 200, 7)


@query(sql_positives(_KINDS, 60, 3))
def positive_sample(spark, sf):
    return evaluate.sample_positives(_kinds(spark, sf), 60, 3)


@query(f"SELECT a, b, true AS match FROM ({sql_positives(_KINDS, 40, 5)}) UNION ALL SELECT a, b, false FROM ({sql_negatives(_KINDS, 80, 5)})")
def pair_sample(spark, sf):
    return evaluate.sample_pairs(_kinds(spark, sf), 40, 80, 5)


@query(_numbered(_KINDS, "id", "PARTITION BY canonical_id"))
def numbered_groups(spark, sf):
    return evaluate.numbered(_kinds(spark, sf), ["canonical_id"], "id").select("id", "canonical_id", "k")


# ---------------------------------------------------------------- evaluations at protocol size

_TWICE = f"SELECT id, CAST(id AS VARCHAR) AS canonical_id FROM ({PEOPLE}) UNION ALL SELECT -id - 1, CAST(id AS VARCHAR) FROM ({PEOPLE})"
_TWICE_POS = f"SELECT id, p0, p2 FROM ({_PEOPLE_POS} ({PEOPLE}))) UNION ALL SELECT -id - 1, p0, p2 FROM ({_PEOPLE_POS} ({NOISY})))"


def _sql_dice(k: int) -> str:
    return f"CASE WHEN len(x.p{k}) + len(y.p{k}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(2 AS DOUBLE) * len(list_intersect(x.p{k}, y.p{k})) / (len(x.p{k}) + len(y.p{k})) END"


def sql_scored(negatives: int, seed: int) -> str:
    """``a, b, label, score`` of all positive pairs (at most the wanted number here) and sampled negative ones."""
    pairs = f"SELECT a, b, true AS label FROM ({sql_all_positives(_TWICE)}) UNION ALL SELECT a, b, false FROM ({sql_negatives(_TWICE, negatives, seed)})"
    return f"""SELECT a, b, label, (CAST(2 AS DOUBLE) * {_sql_dice(0)} + CAST(0.5 AS DOUBLE) * {_sql_dice(2)}) / CAST(2.5 AS DOUBLE) AS score
  FROM ({pairs}) JOIN ({_TWICE_POS}) x ON x.id = a JOIN ({_TWICE_POS}) y ON y.id = b"""


PAIRS = 5000
CALIBRATION_PAIRS = 1000


@query(f"SELECT a, b, label, round(score, 6) AS score FROM ({sql_scored(PAIRS, 1)})")
def scored_pairs(spark, sf):
    return scored(Session(KEY, NAMES), _people_twice(spark, sf), 10**6, PAIRS, 1).select("a", "b", "label", F.round("score", 6).alias("score"))


def _sql_evaluation() -> str:
    rows, points = sql_scored(PAIRS, 1), _points("SELECT label, score FROM rows")
    blocks = "SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM (SELECT score, CAST(count(*) FILTER (label) AS DOUBLE) AS p, CAST(count(*) FILTER (NOT label) AS DOUBLE) AS n FROM rows GROUP BY score)"
    best = {c: f"(SELECT {c} FROM pts ORDER BY f1 DESC, threshold LIMIT 1)" for c in ("f1", "precision", "recall")}
    values = {
        "auroc": f"(SELECT sum(n / nn * (2 * tp - p) / pp / 2) FROM ({blocks}))",
        "auprc": f"(SELECT sum(p / pp * tp / (tp + fp)) FROM ({blocks}))",
        **best,
        "accuracy": "(SELECT max(accuracy) FROM pts)",
        "mcc": "(SELECT max(mcc) FROM pts)",
        "records": f"(SELECT count(*) FROM ({_TWICE}))",
        "positives": "(SELECT count(*) FROM rows WHERE label)",
        "negatives": "(SELECT count(*) FROM rows WHERE NOT label)",
        "timed": "1",
    }
    each = " UNION ALL ".join(f"SELECT '{k}' AS metric, round(CAST({v} AS DOUBLE), 6) AS value" for k, v in values.items())
    return f"WITH rows AS MATERIALIZED ({rows}), pts AS MATERIALIZED ({points}) {each}"


@query(_sql_evaluation())
def evaluation_run(spark, sf):
    """The untuned run, as its report states it: written to the shared folder and read back."""
    out = run(Session(KEY, NAMES), _people_twice(spark, sf), 10**6, PAIRS, 1, 0.5)
    metrics = result_metrics(out)
    times = [metrics.pop(k)["value"] for k in list(metrics) if k.startswith(("tokenize", "match"))]
    counts = out["counts"]
    metrics |= {k: {"value": float(counts[k])} for k in ("records", "positives", "negatives")}
    metrics["timed"] = {"value": float(len(times) == 5 and min(times) > 0)}
    where = f"{shared(spark)}/report.json"
    write_report(spark, {"people": metrics}, where)
    found = spark.read.text(where, wholetext=True).select(F.from_json("value", "map<string, map<string, struct<value: double>>>").alias("r"))
    return found.select(F.explode(F.col("r")["people"])).select(F.col("key").alias("metric"), F.round("value.value", 6).alias("value"))


@query(f"""WITH tuning AS MATERIALIZED (SELECT label, score FROM ({sql_scored(CALIBRATION_PAIRS, 1)})), rows AS MATERIALIZED (SELECT label, score FROM ({sql_scored(PAIRS, 2)})),
    t AS (SELECT threshold FROM ({_points('SELECT label, score FROM tuning')}) ORDER BY f1 DESC, threshold LIMIT 1)
  SELECT threshold, tp, fp, tn, fn FROM ({_points('SELECT label, score FROM rows')}) WHERE threshold = (SELECT threshold FROM t)""")
def calibrated_run(spark, sf):
    """A threshold from 1,000 negative and all positive pairs, judged on 5,000 others and the positive ones."""
    session, rows = Session(KEY, NAMES), _people_twice(spark, sf)
    best = calibrate_on(session, rows, 10**6, CALIBRATION_PAIRS, 1)["threshold"]
    point = evaluate.confusion(scored(session, rows, 10**6, PAIRS, 2, best), best)
    return point.select("threshold", *(F.col(c).cast("long").alias(c) for c in ("tp", "fp", "tn", "fn")))


# ---------------------------------------------------------------- hardening


def _stream(label: bytes, blocks: int) -> str:
    """List of the keyed stream's 64-bit numbers for the value ``v``, four to a block."""
    block = sql_hmac(f"{sql_blob(label + framed(str(FULL).encode()))} || {sql_framed('v')} || unhex(printf('%08x', c))")
    return f"flatten(list_transform(list_transform(range({blocks}), lambda c: {block}), lambda h: [CAST('0x' || substr(h, 1, 16) AS UBIGINT), CAST('0x' || substr(h, 17, 16) AS UBIGINT), CAST('0x' || substr(h, 33, 16) AS UBIGINT), CAST('0x' || substr(h, 49, 16) AS UBIGINT)]))"


_LIMIT = int(HARDENED.flip_probability * (1 << 53))


@query(
    f"""WITH base AS (SELECT id, v, {sql_positions('v', FULL)} AS p FROM (SELECT id, {NORMAL} AS v FROM ({PEOPLE}))),
  flips AS (SELECT id, v, p, list_filter(list_transform({_stream(b'blip:', 512)}, lambda x, i: CASE WHEN x // 2048 < {_LIMIT} THEN i - 1 END), lambda i: i IS NOT NULL) AS f FROM base),
  flipped AS (SELECT id, v, list_concat(list_filter(p, lambda x: NOT list_contains(f, x)), list_filter(f, lambda x: NOT list_contains(p, x))) AS s FROM flips),
  more AS (SELECT id, s, list_distinct(list_filter(list_transform({_stream(b'balance:', 160)}, lambda x: CAST(x % 2048 AS BIGINT)), lambda x: NOT list_contains(s, x))) AS any_order,
    list_filter(list_transform({_stream(b'balance:', 160)}, lambda x: CAST(x % 2048 AS BIGINT)), lambda x: NOT list_contains(s, x)) AS d FROM flipped),
  chosen AS (SELECT id, s, list_transform(list_sort(list_transform(any_order, lambda x: {{'at': list_position(d, x), 'x': x}}))[1:greatest({HARDENED.target_popcount} - len(s), 0)], lambda y: y.x) AS c FROM more)
  SELECT id, len(s) + len(c) AS bits, sha256(array_to_string(list_sort(list_concat(s, c)), ',')) AS digest FROM chosen"""
)
def hardened_tokens(spark, sf):
    fs = FieldSet("hard/1", (FieldSpec(FULL, True),), HARDENED)
    t = Session(KEY, fs).probabilistic(people(spark, sf))
    words = t.select("id", unpacked(F.col("token.fields"))["words"][0].alias("w"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(2047)), lambda i: F.call_function("shiftright", F.get("w", F.floor(i / 64).cast("int")), (i % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    set_bits = words.select("id", bits.alias("b"))
    return set_bits.select("id", F.size("b").cast("long").alias("bits"), F.sha2(F.array_join(F.col("b").cast("array<string>"), ","), 256).alias("digest"))


# ---------------------------------------------------------------- corpora


def shared(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share; a single-JVM session without one takes a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/corpus-{uuid.uuid4().hex}"


@query(_FEBRL)
def corpus_round_trip(spark, sf):
    """The mapped corpus written as JSON lines and read again."""
    where = shared(spark)
    write_corpus(febrl_frames(spark, sf), where)
    return febrl_entries(read_corpus(spark, where))


_ROLL = "SELECT sha_id AS canonical_id, name FROM (SELECT CAST(c_custkey AS VARCHAR) AS sha_id, c_mktsegment || ' É ' || c_name AS name, c_custkey FROM customer) WHERE c_custkey % 2 = 0"


@query(f"{_ROLL} ORDER BY canonical_id LIMIT 100")
def voter_roll_scan(spark, sf):
    """A Latin-1 roll written and read; mapped, in order of id, up to 100 voters. Lines that lack the last columns are padded."""
    where = shared(spark)
    c = table(spark, sf, "customer")
    head = F.lit("\t".join(("ncid", "voter_reg_num", "status_cd", "first_name", "middle_name", "last_name", "res_city_desc", "state_cd", "zip_code")))
    status = F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("I")
    line = F.concat_ws("\t", F.col("c_custkey").cast("string"), F.lit("1"), status, F.concat(F.lit('"'), "c_mktsegment", F.lit('"')), F.lit(" É "), "c_name")
    both = spark.range(1).select(head.alias("value"), F.lit(0).alias("o")).unionByName(c.select(line.alias("value"), F.lit(1).alias("o")))
    both.repartition(1).sortWithinPartitions("o").select("value").write.option("encoding", "ISO-8859-1").csv(where, sep="\x01", quote="", escape="", encoding="ISO-8859-1", quoteAll=False, escapeQuotes=False)
    out = voter_records(read_voters(spark, where), one_in=1, most=100)
    return out.select("canonical_id", F.try_element_at("record", F.lit(str(FULL))).alias("name"))


# ---------------------------------------------------------------- values, gates and rules


@query("SELECT c_custkey AS id, lower(c_mktsegment) || '�ab' || CASE c_custkey % 3 WHEN 0 THEN '�' WHEN 1 THEN '��' ELSE '' END AS value FROM customer")
def utf8_repair(spark, sf):
    """A run of invalid bytes becomes one U+FFFD; genuine ones stay as they are."""
    k = F.col("c_custkey") % 3
    tail = F.when(k == 0, F.unhex(F.lit("C3"))).when(k == 1, F.unhex(F.lit("EFBFBDEFBFBD"))).otherwise(F.unhex(F.lit("")))
    raw = F.concat(F.col("c_mktsegment").cast("binary"), F.unhex(F.lit("FFFEFF")), F.lit("ab").cast("binary"), tail)
    place = path("address", "locality")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), normalize(raw.cast("string"), place)["value"].alias("value"))


@query("SELECT c_custkey AS id, lower(c_mktsegment) || c_custkey AS value, c_custkey % 2 = 0 AS identifier FROM customer")
def foreign_paths(spark, sf):
    """Identifier rules go by the namespace, whoever's it is."""
    mine = FieldPath.parse("acme::identifier::mrn")
    c = table(spark, sf, "customer")
    value = normalize(F.concat("c_mktsegment", F.lit(" -."), F.col("c_custkey").cast("string")), mine)["value"]
    other = FieldPath.parse("acme::name::identifier")
    names = F.when(F.col("c_custkey") % 2 == 0, F.lit(mine.in_namespace("identifier"))).otherwise(F.lit(other.in_namespace("identifier")))
    return c.select(F.col("c_custkey").alias("id"), value.alias("value"), names.alias("identifier"))


@query("SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'version mismatch' WHEN 1 THEN 'key id mismatch' WHEN 2 THEN 'fingerprint mismatch' WHEN 3 THEN 'params mismatch' WHEN 4 THEN 'field count mismatch' END AS reason, c_custkey % 6 <> 3 AS same_params FROM customer")
def token_gates(spark, sf):
    """Why tokens can't be compared; an empty fingerprint goes with any, and hardening is not looked at."""
    t = blocked(spark, sf).select("id", F.col("token").alias("a"))
    k, a = F.col("id") % 6, F.col("a")
    b = (
        a.withField("field_set_version", F.when(k == 0, "other").otherwise(a["field_set_version"]))
        .withField("key_id", F.when(k == 1, "k2").otherwise(a["key_id"]))
        .withField("field_set_fingerprint", F.when(k == 2, "ff").when(k == 5, "").otherwise(a["field_set_fingerprint"]))
        .withField("params", a["params"].withField("hash_count", F.when(k == 3, 9).otherwise(a["params"]["hash_count"])).withField("target_popcount", F.lit(7).cast("long")))
        .withField("fields", F.when(k == 4, F.slice(a["fields"], 1, 2)).otherwise(a["fields"]))
    )
    both = t.select("id", "a", b.alias("b"))
    return both.select("id", similarity.incompatible(F.col("a"), F.col("b")).alias("reason"), (F.col("a.params.hash_count") == F.col("b.params.hash_count")).alias("same_params"))


def _fault(make) -> str:
    try:
        make()
    except ValueError as e:
        return str(e)
    return "none"


def _values(rows: list[tuple]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows) + ") AS t(rule, fault)"


_GIVEN = path(NAME, "given")
_RULES = [
    ("empty version", "fieldset: version must not be empty"),
    ("duplicate", f"fieldset: duplicate field path {_GIVEN}"),
    ("negative weight", f"fieldset: field {_GIVEN} has negative weight -1.0"),
    ("zero weight", "none"),
    ("no bits", "fieldset: size_bits must be > 0"),
    ("no hashes", "fieldset: hash_count must be > 0"),
    ("no grams", "fieldset: ngram_sizes must not be empty"),
    ("empty gram", "fieldset: ngram_sizes must be > 0"),
    ("always flipped", "fieldset: flip_probability must be in [0, 1)"),
    ("all bits set", "fieldset: target_popcount must be < size_bits"),
    ("version before bits", "fieldset: version must not be empty"),
    ("empty secret", "token: secret must not be empty"),
    ("schema before secret", "fieldset: version must not be empty"),
    ("destroyed secret", "token: secret is destroyed"),
    ("copied set", "none"),
    ("own organisation", "none"),
    ("fast", "1024/2"),
    ("default", "2048/3"),
    ("high precision", "4096/5"),
    ("hardened", "2048/3/0.02/400"),
]


@query(_values(_RULES))
def schema_rules(spark, sf):
    """The faults that schemas and sessions raise, first one first, and the presets."""
    one = (FieldSpec(_GIVEN),)

    def made(version="v", fields=one, bloom=DEFAULT):
        return lambda: FieldSet(version, fields, bloom).validate()

    def destroyed():
        session = Session(b"x", LINK)
        session.destroy()
        session.field(F.lit("a"), ID)

    def copied():
        other = LINK.with_bloom(FAST, "other")
        if LINK.bloom != DEFAULT or LINK.version == other.version:
            raise ValueError("the set was changed")

    makes = [
        made(""), made(fields=one * 2), made(fields=(FieldSpec(_GIVEN, False, -1.0),)), made(fields=(FieldSpec(_GIVEN, False, 0.0),)), made(bloom=BloomConfig(0, 3)), made(bloom=BloomConfig(8, 0)),
        made(bloom=BloomConfig(8, 1, ())), made(bloom=BloomConfig(8, 1, (2, 0))), made(bloom=BloomConfig(8, 1, (2,), 1.0)), made(bloom=BloomConfig(8, 1, (2,), 0.0, 8)), made("", bloom=BloomConfig(0, 3)),
        lambda: Session(b"", LINK), lambda: Session(b"", FieldSet("", one)), destroyed, copied, made(fields=(FieldSpec(FieldPath.parse("acme::pet::chip")),)),
    ]
    presets = [f"{p.size_bits}/{p.hash_count}" + (f"/{p.flip_probability}/{p.target_popcount}" if p.hardened else "") for p in (FAST, DEFAULT, HIGH_PRECISION, HARDENED)]
    rows = list(zip((r for r, _ in _RULES), [*map(_fault, makes), *presets]))
    return spark.createDataFrame(rows, "rule string, fault string")


@query("SELECT c_custkey AS id, c_custkey / CAST(4 AS DOUBLE) AS per_second FROM customer")
def throughputs(spark, sf):
    """Records a second, for a run of four."""
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * evaluate.throughput(1, 4.0)).alias("per_second"))
