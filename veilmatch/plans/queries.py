"""Named queries over the driver's tables, each with its SQL twin where SQL has one.

The tables hold no people, so records are derived: a customer's name, key and
nation stand for a full name, a national id and an administrative area. Party
A holds the customers; party B the same ones with one character of the name
dropped (``noisy``) or with other letter case and spacing (``same``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity
from ..functions.normalize import COUNTRY, EMAIL, PHONE, normalize
from ..functions.tokens import _pads, bloom_fields, field_hmac_column, framed, grams_column, positions_column, words_of
from ..operators import evaluate
from ..operators.link import best_match, link_equal, link_similar
from ..operators.tokenize import Tokenizer, annotate, comparable, describe
from ..operators.validate import drop_counts, path_parts, record_errors, record_from_map, sanitize, valid_path
from ..sources.corpus import febrl_corpus, in_hash_sample, token_from_json, token_json, voter_records
from .schema import ADDRESS, DATE, DEFAULT, IDENTIFIER, NAME, FieldPath, FieldSet, FieldSpec, default_field_set, path
from .session import Session, tokenize_all

KEY = b"a throw-away key for checks"
FULL, ID, AREA = path(NAME, "full"), path(IDENTIFIER, "national_id"), path(ADDRESS, "admin_area")
BIRTH, POSTAL = path(DATE, "birth"), path(ADDRESS, "postal_code")
LINK = FieldSet("link/1", (FieldSpec(FULL, True, 1.5), FieldSpec(ID, False, 3.0), FieldSpec(AREA, False, 0.5)), DEFAULT)
NAMES = FieldSet("names/1", (FieldSpec(FULL, True, 2.0), FieldSpec(AREA, False, 0.5), FieldSpec(path(NAME, "middle"), False, 1.0)), DEFAULT)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- SQL pieces


def sql_blob(raw: bytes) -> str:
    return f"unhex('{raw.hex()}')"


def sql_hmac(message: str) -> str:
    inner, outer = _pads(KEY)
    return f"sha256({sql_blob(outer)} || unhex(sha256({sql_blob(inner)} || {message})))"


def sql_framed(v: str) -> str:
    return f"unhex(printf('%08x', octet_length(encode({v})))) || encode({v})"


def sql_field(v: str, p: FieldPath) -> str:
    """Hex of a field's HMAC."""
    return sql_hmac(f"{sql_framed(v)} || {sql_blob(framed(str(p).encode()))}")


def sql_grams(v: str) -> str:
    return f"list_concat(list_transform(range(1, length({v})), lambda i: substr({v}, i, 2)), list_transform(range(1, length({v}) - 1), lambda i: substr({v}, i, 3)))"


def sql_positions(v: str, p: FieldPath) -> str:
    tail = framed(str(p).encode())
    each = ", ".join(f"CAST(CAST('0x' || substr({sql_hmac(f'{sql_framed('g')} || {sql_blob(tail + k.to_bytes(4, 'big'))}')}, 1, 16) AS UBIGINT) % 2048 AS INTEGER)" for k in range(3))
    return f"list_sort(list_distinct(flatten(list_transform(list_distinct({sql_grams(v)}), lambda g: [{each}]))))"


PEOPLE = "SELECT c_custkey AS id, c_name AS name, n_name AS area FROM customer JOIN nation ON c_nationkey = n_nationkey"
NOISY_NAME = "substr(c_name, 1, CAST(c_custkey % length(c_name) AS INTEGER)) || substr(c_name, CAST(c_custkey % length(c_name) AS INTEGER) + 2)"
NOISY = f"SELECT c_custkey AS id, {NOISY_NAME} AS name, n_name AS area FROM customer JOIN nation ON c_nationkey = n_nationkey"
SAME = f"""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '  ' || upper(c_name) || ' ' WHEN 1 THEN c_name ELSE {NOISY_NAME} END AS name, n_name AS area
  FROM customer JOIN nation ON c_nationkey = n_nationkey"""
NORMAL = "trim(lower(name))"


def people(spark: SparkSession, sf: str, party: str = "a") -> DataFrame:
    """``id, name, area, record`` of a party."""
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("area"))
    df = table(spark, sf, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    at = (F.col("c_custkey") % F.length("c_name")).cast("int")
    noisy = F.concat(F.substring("c_name", F.lit(1), at), F.substring("c_name", at + 2, F.length("c_name")))
    turn = F.col("c_custkey") % 3
    same = F.when(turn == 0, F.concat(F.lit("  "), F.upper("c_name"), F.lit(" "))).when(turn == 1, F.col("c_name")).otherwise(noisy)
    name = {"a": F.col("c_name"), "noisy": noisy, "same": same}[party]
    entries = [(FULL, F.col("name")), (ID, F.col("id").cast("string")), (AREA, F.col("area"))]
    df = df.select(F.col("c_custkey").alias("id"), name.alias("name"), "area")
    return df.withColumn("record", F.create_map(*(x for p, c in entries for x in (F.lit(str(p)), c))))


def tokens(spark: SparkSession, sf: str, party: str = "a", fs: FieldSet = LINK) -> DataFrame:
    """``id, block, token, words, pops``; the block is the field token of the area."""
    return comparable(blocked(spark, sf, party, fs)).select("id", "block", "token", "words", "pops")


def blocked(spark: SparkSession, sf: str, party: str = "a", fs: FieldSet = LINK) -> DataFrame:
    """``id, block, token`` of a party."""
    session = Session(KEY, fs, "k1")
    rows = people(spark, sf, party).withColumn("block", F.hex(session.field(F.col("area"), AREA)))
    return session.probabilistic(rows).select("id", "block", "token")


# ---------------------------------------------------------------- schema and paths


@query(f"SELECT 'default' AS name, '0.1' AS version, 16 AS fields, '865cfb4997e71d285775a4e138309c379774adf68e887dfd3d8d31a195526aca' AS fingerprint UNION ALL SELECT 'link', 'link/1', 3, '{LINK.fingerprint()}'")
def fieldset_fingerprint(spark, sf):
    rows = [F.struct(F.lit(n).alias("name"), F.lit(fs.version).alias("version"), F.lit(len(fs.fields)).alias("fields"), F.lit(fs.validate().fingerprint()).alias("fingerprint")) for n, fs in (("default", default_field_set()), ("link", LINK))]
    return spark.range(1).select(F.inline(F.array(*rows)))


_KEYS = "CASE c_custkey % 5 WHEN 0 THEN 'org::name::' || c_mktsegment WHEN 1 THEN 'a::b::c::' || c_name WHEN 2 THEN 'no path' WHEN 3 THEN '::a::b' ELSE 'org::::x' END"


@query(
    f"""SELECT id, CASE WHEN ok THEN split_part(k, '::', 1) END AS org, CASE WHEN ok THEN split_part(k, '::', 2) END AS namespace,
    CASE WHEN ok THEN substr(k, length(split_part(k, '::', 1)) + length(split_part(k, '::', 2)) + 5) END AS name, ok AS valid
  FROM (SELECT c_custkey AS id, {_KEYS} AS k, c_custkey % 5 < 2 AS ok FROM customer)"""
)
def field_path_parse(spark, sf):
    df = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr(_KEYS).alias("k"))
    p = path_parts(F.col("k"))
    return df.select("id", p["org"].alias("org"), p["namespace"].alias("namespace"), p["name"].alias("name"), valid_path(F.col("k")).alias("valid"))


@query(
    f"""SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 1 END AS faults,
    CASE WHEN c_custkey % 2 = 0 THEN 'acme::x::y=not in FieldSet,plain=malformed path,{POSTAL}=not in FieldSet' ELSE '{POSTAL}=not in FieldSet' END AS errors FROM customer"""
)
def record_from_map_errors(spark, sf):
    df = table(spark, sf, "customer")
    base = F.create_map(F.lit(str(FULL)), F.col("c_name"), F.lit(str(POSTAL)), F.lit("123"))
    more = F.map_concat(base, F.create_map(F.lit("plain"), F.lit("x"), F.lit("acme::x::y"), F.lit("z")))
    record, errors = record_from_map(F.when(F.col("c_custkey") % 2 == 0, more).otherwise(base), LINK)
    return df.select(
        F.col("c_custkey").alias("id"),
        F.try_element_at(record, F.lit(str(FULL))).alias("name"),
        F.size(errors).alias("faults"),
        F.array_join(F.transform(errors, lambda e: F.concat(e["key"], F.lit("="), e["reason"])), ",").alias("errors"),
    )


# ---------------------------------------------------------------- normalisation


@query("""SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g')) AS value, CAST(NULL AS VARCHAR) AS error FROM documents""")
def normalize_name(spark, sf):
    n = normalize(F.col("text"), path(NAME, "given"))
    return table(spark, sf, "documents").select("doc_id", n["value"].alias("value"), n["error"].alias("error"))


@query("SELECT c_custkey AS id, translate(lower(n_name || '-' || c_custkey || '. ' || c_name), '-. ', '') AS value FROM customer JOIN nation ON c_nationkey = n_nationkey")
def normalize_identifier(spark, sf):
    raw = F.concat("area", F.lit("-"), F.col("id").cast("string"), F.lit(". "), "name")
    return people(spark, sf).select("id", normalize(raw, ID)["value"].alias("value"))


_DATES = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN '' ELSE strftime(o_orderdate, '%Y-13-%d') END"


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN v END AS value,
    CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 2 THEN 'date value is empty' ELSE 'date must be ISO 8601 YYYY-MM-DD' END AS error FROM (SELECT o_orderkey, {_DATES} AS v FROM orders)"""
)
def normalize_date(spark, sf):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).when(k == 2, "").otherwise(F.date_format("o_orderdate", "yyyy-'13'-dd"))
    n = normalize(raw, BIRTH)
    return table(spark, sf, "orders").select("o_orderkey", n["value"].alias("value"), n["error"].alias("error"))


@query(
    """SELECT c_custkey AS id, CASE k WHEN 0 THEN lower(c_mktsegment) || '.' || c_custkey || '@example.org' WHEN 1 THEN 'x@y' END AS value,
    CASE k WHEN 2 THEN 'email must not contain whitespace' WHEN 3 THEN 'email must contain exactly one ''@''' WHEN 4 THEN 'email must have non-empty local and domain parts' END AS error
  FROM (SELECT *, c_custkey % 5 AS k FROM customer)"""
)
def normalize_email(spark, sf):
    k, i = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit(" "), "c_mktsegment", F.lit("."), i, F.lit("@Example.ORG.. "))).when(k == 1, "X@y.").when(k == 2, F.concat(i, F.lit(" b@c.d"))).when(k == 3, F.concat(i, F.lit("@a@b"))).otherwise(F.concat(i, F.lit("@...")))
    n = normalize(raw, EMAIL)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), n["value"].alias("value"), n["error"].alias("error"))


@query(
    """SELECT c_custkey AS id, CASE WHEN k < 2 THEN CASE k WHEN 0 THEN '+' ELSE '' END || '1555' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS value,
    CASE WHEN k = 2 THEN 'phone must contain at least 7 digits' END AS error FROM (SELECT *, c_custkey % 3 AS k FROM customer)"""
)
def normalize_phone(spark, sf):
    k, i = F.col("c_custkey") % 3, F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    raw = F.when(k == 0, F.concat(F.lit("+1 (555) "), i)).when(k == 1, F.concat(F.lit("(+1) 555-"), i)).otherwise("12-34 x56")
    n = normalize(raw, PHONE)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), n["value"].alias("value"), n["error"].alias("error"))


@query(
    """SELECT c_custkey AS id, CASE WHEN k = 0 THEN substr(c_mktsegment, 1, 2) END AS value,
    CASE k WHEN 1 THEN 'country code must be 2 characters' WHEN 2 THEN 'country code must be 2 ASCII letters' END AS error FROM (SELECT *, c_custkey % 3 AS k FROM customer)"""
)
def normalize_country(spark, sf):
    k = F.col("c_custkey") % 3
    raw = F.when(k == 0, F.lower(F.substring("c_mktsegment", 1, 2))).when(k == 1, F.substring("c_mktsegment", 1, 3)).otherwise(F.concat(F.lit("ß"), (F.col("c_custkey") % 10).cast("string")))
    n = normalize(raw, COUNTRY)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), n["value"].alias("value"), n["error"].alias("error"))


@query("SELECT p_partkey, trim(regexp_replace(lower('  ' || p_brand || chr(9) || '  ' || p_type || ' '), '\\s+', ' ', 'g')) AS value FROM part")
def normalize_default(spark, sf):
    raw = F.concat(F.lit("  "), "p_brand", F.lit("\t  "), "p_type", F.lit(" "))
    return table(spark, sf, "part").select("p_partkey", normalize(raw, POSTAL)["value"].alias("value"))


# ---------------------------------------------------------------- validation

VALID = FieldSet("v1", (FieldSpec(FULL, True), FieldSpec(BIRTH, False), FieldSpec(COUNTRY, False)))


def _flawed(spark, sf) -> DataFrame:
    """Order records: every second has no name, every third a bad date, every fifth an unknown field."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    entries = F.array(
        F.struct(F.lit(str(FULL)).alias("k"), F.when(k % 2 == 1, F.col("o_orderpriority")).alias("v")),
        F.struct(F.lit(str(BIRTH)).alias("k"), F.when(k % 3 == 0, "bad").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("v")),
        F.struct(F.lit("acme::x::y").alias("k"), F.when(k % 5 == 0, "z").alias("v")),
    )
    return o.select(k.alias("id"), F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias("record"))


@query(
    f"""SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'field "{BIRTH}": date must be ISO 8601 YYYY-MM-DD' END,
    CASE WHEN o_orderkey % 2 = 0 THEN 'required field "{FULL}" missing' END, CASE WHEN o_orderkey % 5 = 0 THEN 'unknown field "acme::x::y" (not in FieldSet)' END], lambda x: x IS NOT NULL), '; ') AS errors
  FROM orders"""
)
def validate_record(spark, sf):
    return _flawed(spark, sf).select("id", F.array_join(record_errors("record", VALID), "; ").alias("errors"))


@query(
    f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 1 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 <> 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS fields, CASE WHEN o_orderkey % 3 = 0 THEN 'date must be ISO 8601 YYYY-MM-DD' END AS dropped FROM orders"
)
def sanitize_records(spark, sf):
    clean = sanitize(_flawed(spark, sf), VALID)
    return clean.select("id", F.size("record").alias("fields"), F.try_element_at("dropped", F.lit(str(BIRTH))).alias("dropped"))


@query(f"SELECT '{BIRTH}' AS path, count(*) AS drops FROM orders WHERE o_orderkey % 3 = 0")
def sanitize_counts(spark, sf):
    return drop_counts(sanitize(_flawed(spark, sf), VALID))


# ---------------------------------------------------------------- tokens


@query("SELECT id, array_to_string(g, '|') AS grams, len(g) AS n FROM (SELECT id, " + sql_grams("v") + f" AS g FROM (SELECT id, {NORMAL} AS v FROM ({PEOPLE})))")
def ngrams(spark, sf):
    g = grams_column(F.col("v"), (2, 3))
    return people(spark, sf).withColumn("v", normalize(F.col("name"), FULL)["value"]).select("id", F.array_join(g, "|").alias("grams"), F.size(g).cast("long").alias("n"))


@query(f"SELECT id, {sql_field(NORMAL, FULL)} AS token FROM ({PEOPLE})")
def hmac_field(spark, sf):
    value = normalize(F.col("name"), FULL)["value"]
    return people(spark, sf).select("id", F.lower(F.hex(field_hmac_column(KEY, value, str(FULL)))).alias("token"))


@query(f"SELECT id, {sql_field('lower(area)', AREA)} AS block FROM ({PEOPLE})")
def blocking_key(spark, sf):
    return people(spark, sf).select("id", F.lower(F.hex(Tokenizer(KEY).field(F.col("area"), AREA))).alias("block"))


_DET = f"SELECT id, {sql_field(NORMAL, FULL)} AS f0, {sql_field('CAST(id AS VARCHAR)', ID)} AS f1, {sql_field('lower(area)', AREA)} AS f2"


@query(f"SELECT id, 'link/1' AS version, 'k1' AS key_id, '{LINK.fingerprint()}' AS fingerprint, f0 || ',' || f1 || ',' || f2 AS fields FROM ({_DET} FROM ({PEOPLE}))")
def det_token(spark, sf):
    t = Session(KEY, LINK, "k1").deterministic(people(spark, sf))
    f = F.array_join(F.transform("token.fields", lambda x: F.lower(F.hex(x))), ",")
    return t.select("id", F.col("token.field_set_version").alias("version"), "token.key_id", F.col("token.field_set_fingerprint").alias("fingerprint"), f.alias("fields"))


def _det(spark, sf, party) -> DataFrame:
    return Session(KEY, LINK, "k1").deterministic(people(spark, sf, party)).select("id", "token")


_EQ = f"SELECT a.id, b.id AS id_r FROM ({PEOPLE}) a JOIN ({SAME}) b ON trim(lower(a.name)) = trim(lower(b.name)) AND a.id = b.id AND a.area = b.area"


@query(_EQ)
def det_equal_join(spark, sf):
    return link_equal(_det(spark, sf, "a"), _det(spark, sf, "same")).select("id", "id_r")


@query(f"SELECT id FROM ({_EQ})")
def det_semi_join(spark, sf):
    return link_equal(_det(spark, sf, "a"), _det(spark, sf, "same"), "left_semi").select("id")


@query(f"SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM ({_EQ}))")
def det_anti_join(spark, sf):
    return link_equal(_det(spark, sf, "a"), _det(spark, sf, "same"), "left_anti").select("id")


@query(
    f"""SELECT id, '{{"field_set_version":"link/1","key_id":"k1","field_set_fingerprint":"{LINK.fingerprint()}","fields":["' || base64(unhex(f0)) || '","' || base64(unhex(f1)) || '","' || base64(unhex(f2)) || '"]}}' AS json
  FROM ({_DET} FROM ({PEOPLE}))"""
)
def token_to_json(spark, sf):
    return _det(spark, sf, "a").select("id", token_json(F.col("token")).alias("json"))


@query("SELECT c_custkey AS id, true AS same FROM customer")
def token_json_round_trip(spark, sf):
    t = tokens(spark, sf)
    return t.select("id", (token_from_json(token_json(F.col("token"), True), True) == F.col("token")).alias("same"))


@query(f"SELECT id, array_to_string({sql_positions('v', FULL)}, ',') AS positions FROM (SELECT id, {NORMAL} AS v FROM ({PEOPLE}))")
def bloom_positions(spark, sf):
    p = positions_column(KEY, F.col("v"), str(FULL), DEFAULT)
    return people(spark, sf).withColumn("v", normalize(F.col("name"), FULL)["value"]).select("id", F.array_join(p.cast("array<string>"), ",").alias("positions"))


_PEOPLE_POS = f"SELECT id, area, {sql_positions('v', FULL)} AS p0, {sql_positions('number', ID)} AS p1, {sql_positions('place', AREA)} AS p2 FROM (SELECT id, area, {NORMAL} AS v, CAST(id AS VARCHAR) AS number, lower(area) AS place FROM "


@query(
    f"""SELECT id, w AS word, CAST(list_sum(list_transform(list_filter(p, lambda x: x // 64 = w), lambda x: CASE WHEN x % 64 = 63 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << (x % 64) END)) AS BIGINT) AS bits
  FROM (SELECT id, p0 AS p, unnest(list_sort(list_distinct(list_transform(p0, lambda x: x // 64)))) AS w FROM ({_PEOPLE_POS} ({PEOPLE}))))"""
)
def bloom_words(spark, sf):
    values = F.array(normalize(F.col("name"), FULL)["value"])
    rows = people(spark, sf).withColumn("f", bloom_fields(values, [str(FULL)], DEFAULT, Tokenizer(KEY).secret)[0])
    rows = rows.select("id", F.posexplode(words_of(F.col("f"))).alias("word", "bits"))
    return rows.where("bits <> 0").select("id", F.col("word").cast("int"), "bits")


@query(f"SELECT id, CAST(len(p0) AS INTEGER) AS name, CAST(len(p1) AS INTEGER) AS national_id, CAST(len(p2) AS INTEGER) AS area FROM ({_PEOPLE_POS} ({PEOPLE})))")
def popcounts(spark, sf):
    return tokens(spark, sf).select("id", *(F.col("pops")[k].alias(n) for k, n in enumerate(("name", "national_id", "area"))))


@query(
    f"""SELECT c_custkey AS id, 'DeterministicToken{{v=link/1 key=k1 fp={LINK.fingerprint()[:8]} fields=3/3 bytes=96}}' AS det,
    'ProbabilisticToken{{v=link/1 key=k1 fp={LINK.fingerprint()[:8]} size=2048b fields=3/3 bytes=768}}' AS bloom FROM customer"""
)
def describe_tokens(spark, sf):
    p, s = people(spark, sf), Session(KEY, LINK, "k1")
    both = s.probabilistic(s.deterministic(p).withColumnRenamed("token", "det"))
    return both.select("id", describe(F.col("det")).alias("det"), describe(F.col("token"), True).alias("bloom"))


@query(f"SELECT c_custkey AS id, p AS path, p <> '{path(NAME, 'middle')}' AS present, 256 AS byte_count FROM customer, (SELECT unnest(['{FULL}', '{AREA}', '{path(NAME, 'middle')}']) AS p)")
def annotate_tokens(spark, sf):
    t = tokens(spark, sf, fs=NAMES)
    return t.select("id", F.inline(annotate(F.col("token"), NAMES, True)["fields"]))


# ---------------------------------------------------------------- comparison


def _dice(k: int) -> str:
    return f"CASE WHEN len(a.p{k}) + len(b.p{k}) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a.p{k}, b.p{k})) / (len(a.p{k}) + len(b.p{k})) END"


_SCORED = f"SELECT a.id, b.id AS id_r, {_dice(0)} AS d0, {_dice(1)} AS d1, {_dice(2)} AS d2 FROM ({_PEOPLE_POS} ({PEOPLE}))) a JOIN ({_PEOPLE_POS} ({NOISY}))) b ON "


def _own(spark, sf) -> DataFrame:
    """Every customer beside its noisy copy."""
    b = tokens(spark, sf, "noisy")
    return tokens(spark, sf).join(b.select(*(F.col(c).alias(f"{c}_r") for c in b.columns)), F.col("id") == F.col("id_r"))


def _scores(n: int = 3) -> list[Column]:
    return similarity.per_field(F.col("words"), F.col("words_r"), F.col("pops"), F.col("pops_r"), n)


@query(f"SELECT id, round(d0, 6) AS name, round(d1, 6) AS national_id, round(d2, 6) AS area FROM ({_SCORED} a.id = b.id)")
def dice_per_field(spark, sf):
    return _own(spark, sf).select("id", *(F.round(s, 6).alias(n) for s, n in zip(_scores(), ("name", "national_id", "area"))))


@query(f"SELECT id, round((1.5 * d0 + 3.0 * d1 + 0.5 * d2) / 5.0, 6) AS score FROM ({_SCORED} a.id = b.id)")
def weighted_score(spark, sf):
    return _own(spark, sf).select("id", F.round(similarity.score(_scores(), LINK), 6).alias("score"))


_SUM = "1.5 * d0 + CASE WHEN id_r < 10 AND id < 10 THEN 0 ELSE 3.0 * d1 END + 0.5 * d2"


@query(
    f"""SELECT id, round(s / w, 6) AS score, s / w >= 0.9 AS is_match, n AS comparable_fields, round(d0, 6) AS name_score
  FROM (SELECT *, {_SUM} AS s, CASE WHEN id < 10 THEN 2.0 ELSE 5.0 END AS w, CASE WHEN id < 10 THEN 2 ELSE 3 END AS n FROM ({_SCORED} a.id = b.id))"""
)
def match_own(spark, sf):
    m = similarity.match(_scores(), F.col("pops"), F.col("pops_r"), LINK, 0.9)
    out = _own(spark, sf).select("id", m.alias("m"))
    return out.select("id", F.round("m.score", 6).alias("score"), "m.is_match", "m.comparable_fields", F.round(similarity.score_for(F.col("m"), str(FULL)), 6).alias("name_score"))


@query("SELECT c_custkey AS id, CAST(0 AS DOUBLE) AS score, false AS is_match, 0 AS comparable_fields FROM customer")
def match_both_absent(spark, sf):
    fs = FieldSet("absent/1", (FieldSpec(path(NAME, "middle")), FieldSpec(POSTAL)), DEFAULT)
    t = tokens(spark, sf, fs=fs)
    m = similarity.match(similarity.per_field(F.col("words"), F.col("words"), F.col("pops"), F.col("pops"), 2), F.col("pops"), F.col("pops"), fs, 0.0)
    return t.select("id", m.alias("m")).select("id", "m.score", "m.is_match", "m.comparable_fields")


_PAIR_SUM = "(1.5 * d0 + CASE WHEN id < 10 AND id_r < 10 THEN 0.0 ELSE 3.0 * d1 END + 0.5 * d2) / CASE WHEN id < 10 AND id_r < 10 THEN 2.0 ELSE 5.0 END"
_MATCHED = f"SELECT id, id_r, {_PAIR_SUM} AS score, CASE WHEN id < 10 AND id_r < 10 THEN 2 ELSE 3 END AS comparable_fields FROM ({_SCORED} a.area = b.area) WHERE {_PAIR_SUM} >= 0.8"


def _linked(spark, sf) -> DataFrame:
    return link_similar(blocked(spark, sf), blocked(spark, sf, "noisy"), LINK, 0.8, block="block")


@query(f"SELECT id, id_r, round(score, 6) AS score, comparable_fields FROM ({_MATCHED})")
def match_blocked(spark, sf):
    return _linked(spark, sf).select("id", "id_r", F.round("result.score", 6).alias("score"), "result.comparable_fields")


@query(f"SELECT id, id_r, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, id_r) AS rank FROM ({_MATCHED})) WHERE rank = 1")
def best_matches(spark, sf):
    return best_match(_linked(spark, sf)).select("id", "id_r", F.round("result.score", 6).alias("score"))


@query(
    f"""SELECT s.s_suppkey AS id, n.n_nationkey AS id_r, round({_dice(0)}, 6) AS score FROM
  (SELECT s_suppkey, {sql_positions('lower(s_name)', FULL)} AS p0 FROM supplier) s JOIN (SELECT n_nationkey, {sql_positions('lower(n_name)', FULL)} AS p0 FROM nation) n ON true""".replace("a.p0", "s.p0").replace("b.p0", "n.p0")
)
def match_unblocked(spark, sf):
    fs = FieldSet("one/1", (FieldSpec(FULL),), DEFAULT)
    session = Session(KEY, fs)

    def side(name, i, v):
        return session.probabilistic(table(spark, sf, name).select(F.col(i).alias("id"), F.col(v).alias("v")), columns={str(FULL): "v"})

    pairs = link_similar(side("supplier", "s_suppkey", "s_name"), side("nation", "n_nationkey", "n_name"), fs, 0.0, unblocked=True, keep_all=True)
    return pairs.select("id", F.col("id_r").cast("int"), F.round("result.score", 6).alias("score"))


# ---------------------------------------------------------------- evaluation

_LABELLED = "SELECT l.doc_id, (d.n_chars * 37 % 101) / 100.0 * 0.5 + toxic * 0.3 AS score, toxic = 1 AS label FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def _labelled(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    s = (F.col("n_chars") * 37 % 101) / F.lit(100.0) * 0.5 + F.col("toxic") * 0.3
    return table(spark, sf, "labels").join(d, "doc_id").select("doc_id", s.alias("score"), (F.col("toxic") == 1).alias("label"))


_COUNTS = "count(*) FILTER (score >= t AND label) AS tp, count(*) FILTER (score >= t AND NOT label) AS fp, count(*) FILTER (score < t AND NOT label) AS tn, count(*) FILTER (score < t AND label) AS fn"


def _points(source: str) -> str:
    """Operating points at 101 thresholds of rows with ``score`` and ``label``."""
    return f"""SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (
  SELECT t AS threshold, tp, fp, tn, fn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS recall,
    (tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE) AS accuracy, CASE WHEN fp + tn = 0 THEN 0.0 ELSE fp / CAST(fp + tn AS DOUBLE) END AS fpr,
    CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0 ELSE (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc
  FROM (SELECT t, {_COUNTS} FROM ({source}), (SELECT unnest(range(0, 101)) / 100.0 AS t) GROUP BY t))"""


_POINTS = _points(_LABELLED)
_ROUNDED = "threshold, tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, round(fpr, 6) AS fpr, round(mcc, 6) AS mcc"


def _rounded(df: DataFrame) -> DataFrame:
    ratios = ("precision", "recall", "f1", "accuracy", "fpr", "mcc")
    return df.select("threshold", *(F.col(c).cast("long").alias(c) for c in ("tp", "fp", "tn", "fn")), *(F.round(c, 6).alias(c) for c in ratios))


@query(f"SELECT {_ROUNDED} FROM ({_POINTS})")
def threshold_sweep(spark, sf):
    return _rounded(evaluate.sweep(_labelled(spark, sf)))


@query(f"SELECT {_ROUNDED} FROM ({_POINTS}) WHERE threshold = 0.5")
def confusion_at(spark, sf):
    return _rounded(evaluate.confusion(_labelled(spark, sf), 0.5))


def _best(by: str, where: str = "true") -> str:
    return f"SELECT {_ROUNDED} FROM ({_POINTS}) WHERE {where} ORDER BY {by} DESC, threshold LIMIT 1"


@query(f"SELECT threshold, precision, recall, f1 FROM ({_best('f1')})")
def calibrate_threshold(spark, sf):
    return evaluate.calibrate(_labelled(spark, sf)).select("threshold", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(_best("mcc"))
def best_mcc(spark, sf):
    return _rounded(evaluate.pick_best(evaluate.sweep(_labelled(spark, sf)), "mcc"))


@query(_best("accuracy"))
def best_accuracy(spark, sf):
    return _rounded(evaluate.pick_best(evaluate.sweep(_labelled(spark, sf)), "accuracy"))


@query(_best("precision", "recall >= 0.95"))
def precision_at_recall(spark, sf):
    return _rounded(evaluate.pick_at(evaluate.sweep(_labelled(spark, sf)), "recall", 0.95, "precision"))


@query(_best("recall", "precision >= 0.5"))
def recall_at_precision(spark, sf):
    return _rounded(evaluate.pick_at(evaluate.sweep(_labelled(spark, sf)), "precision", 0.5, "recall"))


_BLOCKS = f"SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM (SELECT score, CAST(count(*) FILTER (label) AS DOUBLE) AS p, CAST(count(*) FILTER (NOT label) AS DOUBLE) AS n FROM ({_LABELLED}) GROUP BY score)"


@query(f"SELECT round(sum(n / nn * (2 * tp - p) / pp / 2), 6) AS auroc FROM ({_BLOCKS})")
def auroc_score(spark, sf):
    return evaluate.auroc(_labelled(spark, sf)).select(F.round("auroc", 6).alias("auroc"))


@query(f"SELECT round(sum(p / pp * tp / (tp + fp)), 6) AS auprc FROM ({_BLOCKS})")
def auprc_score(spark, sf):
    return evaluate.auprc(_labelled(spark, sf)).select(F.round("auprc", 6).alias("auprc"))


@query("SELECT event_type, count(*) AS count, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    ranks = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("value").alias("count"), F.round(F.avg("value"), 6).alias("mean"), *ranks, F.max("value").alias("max"))


@query("SELECT count(value) AS count, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max FROM events")
def latency_overall(spark, sf):
    return evaluate.latency_summary(table(spark, sf, "events"), "value").withColumn("mean", F.round("mean", 6))


@query("SELECT toxic = 1 AS label, count(*) AS pairs FROM labels GROUP BY toxic")
def label_counts(spark, sf):
    return table(spark, sf, "labels").groupBy((F.col("toxic") == 1).alias("label")).agg(F.count("*").alias("pairs"))


def _groups(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_name", "p_brand", "p_type", "p_size").alias("canonical_id"))


_GROUPS = "SELECT p_partkey AS id, p_name || '/' || p_brand || '/' || p_type || '/' || p_size AS canonical_id FROM part"


@query(f"SELECT canonical_id, array_to_string(list_sort(list(id)), ',') AS ids, count(*) AS n FROM ({_GROUPS}) GROUP BY canonical_id")
def group_by_canonical(spark, sf):
    return evaluate.group_by(_groups(spark, sf)).select("canonical_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "n")


@query(f"SELECT x.id AS a, y.id AS b FROM ({_GROUPS}) x JOIN ({_GROUPS}) y ON x.canonical_id = y.canonical_id AND x.id < y.id")
def positive_pairs(spark, sf):
    return evaluate.positive_pairs(_groups(spark, sf))


def _people_twice(spark, sf) -> DataFrame:
    """Both parties with ground truth, for whole evaluations."""
    a = people(spark, sf).select("id", F.col("id").cast("string").alias("canonical_id"), "record")
    return a.unionByName(people(spark, sf, "noisy").select((-F.col("id") - 1).alias("id"), F.col("id").cast("string").alias("canonical_id"), "record"))


@query(f"SELECT id, len(p0) > 0 AS name FROM ({_PEOPLE_POS} ({PEOPLE})))")
def tokenize_all_records(spark, sf):
    t, _ = tokenize_all(Session(KEY, LINK), people(spark, sf))
    return t.select("id", (F.col("pops")[0] > 0).alias("name"))


# ---------------------------------------------------------------- corpora and corruption


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE CAST('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 16) AS UBIGINT) % 7 = 0")
def hash_sample(spark, sf):
    i = F.col("c_custkey").cast("string")
    return table(spark, sf, "customer").where(in_hash_sample(i, 7)).select(i.alias("id"))


_FEBRL = f"""SELECT CAST(c_custkey AS VARCHAR) AS canonical_id, 'rec-' || c_custkey || '-' || k AS entity_id, unnest([
    '{path(NAME, 'given')}=' || c_mktsegment, '{path(NAME, 'family')}=' || c_name, '{ID}=' || c_custkey, '{BIRTH}=1970-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0'),
    '{FULL}=' || c_mktsegment || ' ' || c_name, '{COUNTRY}=AU']) AS entry FROM customer, (SELECT unnest(['org', 'dup-0']) AS k)"""


def febrl_frames(spark, sf) -> DataFrame:
    """The corpus of two frames made from customers."""

    def frame(kind):
        c = table(spark, sf, "customer")
        day = F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0")
        return c.select(
            F.concat(F.lit("rec-"), F.col("c_custkey"), F.lit(f"-{kind}")).alias("rec_id"), F.col("c_mktsegment").alias("given_name"), F.concat(F.lit(" "), "c_name").alias("surname"),
            F.col("c_custkey").alias("soc_sec_id"), F.lit(" ").alias("postcode"), F.lit(None).cast("string").alias("suburb"), F.lit("").alias("state"), F.concat(F.lit("197001"), day).alias("date_of_birth"),
        )

    return febrl_corpus(frame("org"), frame("dup-0"))


def febrl_entries(out: DataFrame) -> DataFrame:
    return out.select("canonical_id", "entity_id", F.explode(F.map_entries("record")).alias("e")).select("canonical_id", "entity_id", F.concat("e.key", F.lit("="), "e.value").alias("entry"))


@query(_FEBRL)
def febrl_mapping(spark, sf):
    return febrl_entries(febrl_frames(spark, sf))


@query(
    f"""SELECT CAST(c_custkey AS VARCHAR) AS canonical_id, unnest(['{path(NAME, 'given')}=' || c_mktsegment, '{path(NAME, 'family')}=' || c_name, '{FULL}=' || c_mktsegment || ' ' || c_name,
    '{path(ADDRESS, 'locality')}=' || n_name, '{AREA}=NC', '{POSTAL}=' || lpad(CAST(c_custkey AS VARCHAR), 5, '0'), '{COUNTRY}=US']) AS entry
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0 AND CAST('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 16) AS UBIGINT) % 3 = 0"""
)
def voter_mapping(spark, sf):
    p = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    i = F.col("c_custkey").cast("string")
    rows = p.select(
        i.alias("ncid"), F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("I").alias("status_cd"), F.col("c_mktsegment").alias("first_name"), F.lit("").alias("middle_name"), F.col("c_name").alias("last_name"),
        F.col("n_name").alias("res_city_desc"), F.lit("NC").alias("state_cd"), F.concat(F.lpad(i, 5, "0"), F.lit("1234")).alias("zip_code"),
    )
    out = voter_records(rows, one_in=3, most=None)
    return out.select("canonical_id", F.explode(F.map_entries("record")).alias("e")).select("canonical_id", F.concat("e.key", F.lit("="), "e.value").alias("entry"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return match_blocked(spark, sf)
