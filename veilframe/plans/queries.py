"""The engine's queries over the driver's tables, with what DuckDB gives for the same in SQL.

The tables hold no Russian text, so the context detectors run over sentences of our own (plans/cases.py), dealt out
over the customers with their keys in them; their marks say what SQL has to mask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import calendar, checks, masks, scrub, text
from veilframe.functions.types import NAMES
from veilframe.operators import dictionary, metrics, native, relational
from veilframe.operators import spans as S
from veilframe.operators.detect import detect, detect_long, explode_chunks, register_chunks
from veilframe.plans import cases
from veilframe.plans import config as C
from veilframe.plans.engine import Engine

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if it has any."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL of masks: KEEP2 and ALL of an expression {x}
ALL = "regexp_replace({x}, '[\\p{{L}}\\p{{Nd}}]', '*', 'g')"
KEEP2 = (
    "CASE WHEN length(regexp_replace({x}, '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) <= 4 THEN " + ALL + " ELSE "
    "regexp_extract({x}, '^((?:[^\\p{{L}}\\p{{Nd}}]*[\\p{{L}}\\p{{Nd}}]){{2}})', 1) || regexp_replace(substr({x}, "
    "1 + length(regexp_extract({x}, '^((?:[^\\p{{L}}\\p{{Nd}}]*[\\p{{L}}\\p{{Nd}}]){{2}})', 1)), "
    "length({x}) - length(regexp_extract({x}, '^((?:[^\\p{{L}}\\p{{Nd}}]*[\\p{{L}}\\p{{Nd}}]){{2}})', 1)) - length(regexp_extract({x}, '((?:[\\p{{L}}\\p{{Nd}}][^\\p{{L}}\\p{{Nd}}]*){{2}})$', 1))), "
    "'[\\p{{L}}\\p{{Nd}}]', '*', 'g') || regexp_extract({x}, '((?:[\\p{{L}}\\p{{Nd}}][^\\p{{L}}\\p{{Nd}}]*){{2}})$', 1) END"
)
EMAILS = r"regexp_extract_all(lower(text), '(?:^|[^\p{L}\p{Nd}_.+-])([a-z0-9][a-z0-9._+-]*@(?:[a-z0-9-]+\.)+[a-z]{2,})', 1)"
CARDS = r"regexp_extract_all(text, '(?:^|[^\p{L}\p{Nd}_.-])([0-9]{16})', 1)"
PHONES = r"regexp_extract_all(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}')"
LUHN = "(list_sum([CASE WHEN i % 2 = 0 THEN CASE WHEN {x}[17 - i]::INT > 4 THEN {x}[17 - i]::INT * 2 - 9 ELSE {x}[17 - i]::INT * 2 END ELSE {x}[17 - i]::INT END FOR i IN range(1, 17)]) % 10 = 0)"


@query(f"SELECT source, count(*) AS n_docs, sum(len({EMAILS})) AS n_emails, count(*) FILTER (len({EMAILS}) > 0) AS n_with FROM documents GROUP BY source")
def pii_emails_by_source(spark, sf_dir):
    """E-mail addresses by source: native detection, resolution, rule floor, counts."""
    found = detect(table(spark, sf_dir, "documents").select("source", "text"), "text", ["EMAIL"])
    n = F.size(F.filter("spans", lambda s: s["conf"] >= 0.7))
    return found.select("source", n.alias("n")).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_emails"), F.sum((F.col("n") > 0).cast("long")).alias("n_with"))


@query(f"SELECT doc_id, list_reduce(list_prepend(text, list_distinct({EMAILS})), lambda acc, e: replace(acc, e, {KEEP2.format(x='e')})) AS masked FROM documents")
def pii_mask_emails(spark, sf_dir):
    """Every document with its e-mail addresses masked, by their values as its SQL does."""
    c = C.default()
    c.mailboxes = "ascii"
    for name, rule in c.systems[0].types.items():
        rule.enabled = name == "EMAIL"
    out = Engine(c).mask_values(table(spark, sf_dir, "documents").select("doc_id", "text"), text="text")
    return out.select("doc_id", "masked")


@query(f"SELECT doc_id, list_reduce(list_prepend(text, list_distinct({EMAILS})), lambda acc, e: replace(acc, e, '[ПОЧТА]')) AS masked FROM documents WHERE len({EMAILS}) > 0")
def pii_label_emails(spark, sf_dir):
    c = C.preset("labels")
    for name, rule in c.systems[0].types.items():
        rule.enabled = name == "EMAIL"
    out = Engine(c).mask(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return out.where(F.size("replacements") > 0).select("doc_id", "masked")


@query(f"SELECT doc_id, c AS card, {LUHN.format(x='c')} AS valid FROM (SELECT doc_id, unnest({CARDS}) AS c FROM documents) WHERE {LUHN.format(x='c')}")
def pii_cards(spark, sf_dir):
    """Card numbers with a valid check digit, by place and value."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", text.utf8("text").alias("data"), F.explode(S.resolve(native.detect("text", ["CARD_NUMBER"]))).alias("s"))
    value = text.byte_slice(F.col("data"), F.col("s.start"), F.col("s.end"))
    return found.select("doc_id", value.alias("card"), checks.luhn(text.digits_only(value)).alias("valid"))


@query(f"""SELECT doc_id, len({EMAILS}) AS emails, len({PHONES}) AS phones FROM documents WHERE len({EMAILS}) + len({PHONES}) > 0""")
def pii_scan_contacts(spark, sf_dir):
    """E-mail addresses and phones of every document, by the context scanners."""
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["EMAIL", "PHONE", "CARD_NUMBER"])
    counted = found.select("doc_id", S.type_counts(F.col("spans")).alias("n"))
    pick = lambda t: F.coalesce(F.try_element_at("n", F.lit(t)), F.lit(0)).cast("long")
    return counted.select("doc_id", pick("EMAIL").alias("emails"), pick("PHONE").alias("phones")).where("emails + phones > 0")


@query(r"SELECT source, count(*) AS n, sum(len(regexp_extract_all(text, '[0-9]{1,3}(?:\.[0-9]{1,3}){3}'))) AS ips FROM documents GROUP BY source")
def pii_custom_type(spark, sf_dir):
    """A user-defined category: dotted addresses."""
    found = detect(table(spark, sf_dir, "documents").select("source", "text"), "text", [], [C.CustomType("IP_ADDRESS", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")])
    return found.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.size("spans")).alias("ips"))


@query()
def pii_all_types(spark, sf_dir):
    """All thirty categories over all documents: counts by source and category."""
    out = Engine(C.default()).mask(table(spark, sf_dir, "documents").select("source", "text"), "text")
    return metrics.pii_counts(out, ["source"])


KEY = "lpad((c_custkey % 1000000)::VARCHAR, 6, '0')"
INITIALS = "array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+'), lambda w: upper(w[1]) || '.'), ' ')"
#: The SQL of each category's default mask.
MASK_SQL = dict.fromkeys(NAMES, KEEP2) | {"FIO": INITIALS, "CARD_HOLDER": INITIALS, "CVV": ALL, "PIN": ALL}


def text_sql(part: str) -> str:
    """A piece of a sentence as SQL, with the customer's key in its place."""
    return "(" + f" || {KEY} || ".join("'" + x.replace("'", "''") + "'" for x in part.split("{k}")) + ")"


def sentence_sql(sentence: str, masked: bool) -> str:
    return " || ".join(MASK_SQL[c].format(x=text_sql(t)) if c and masked else text_sql(t) for c, t in cases.pieces(sentence))


def turn_sql(parts: list[str]) -> str:
    """The part that is the customer's turn."""
    return f"CASE c_custkey % {len(parts)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(parts)) + " END"


def told(spark, sf_dir, sentences: list[str]) -> DataFrame:
    """(c_custkey, turn, payload): one of the sentences for each customer, with the customer's key in it."""
    texts = F.array(*[F.lit(cases.plain(x)) for x in sentences])
    key = F.lpad((F.col("c_custkey") % 1000000).cast("string"), 6, "0")
    turn = (F.col("c_custkey") % len(sentences)).cast("int")
    return table(spark, sf_dir, "customer").select("c_custkey", turn.alias("turn"), F.replace(F.element_at(texts, turn + 1), F.lit("{k}"), key).alias("payload"))


def only(types: list[str]) -> C.Config:
    c = C.default()
    for t, rule in c.systems[0].types.items():
        rule.enabled = t in types
    return c


def family(name: str, types: list[str], sentences: list[str]):
    """A query that masks a family's sentences, dealt out over the customers, by the family's detectors."""

    def run(spark, sf_dir):
        return Engine(only(types)).mask(told(spark, sf_dir, sentences).drop("turn")).select("c_custkey", "payload", "masked")

    run.__name__ = f"pii_detect_{name}"
    QUERIES[run.__name__] = run
    ORACLES[run.__name__] = f"SELECT c_custkey, {turn_sql([sentence_sql(x, False) for x in sentences])} AS payload, {turn_sql([sentence_sql(x, True) for x in sentences])} AS masked FROM customer"


for _name, (_types, _sentences) in cases.FAMILIES.items():
    family(_name, _types, _sentences)
EVERY = [x for _, sentences in cases.FAMILIES.values() for x in sentences]


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'карта 41** **** **** **11, пин ****' ELSE 'пин 4821' END AS masked FROM customer")
def rule_companion(spark, sf_dir):
    """A rule that masks a PIN only where the payload holds a card, too."""
    payload = F.when(F.col("c_custkey") % 2 == 0, "карта 4111 1111 1111 1111, пин 4821").otherwise("пин 4821")
    c = C.default()
    c.systems[0].types["PIN"].requires_companion = ["CARD_NUMBER"]
    return Engine(c).mask(table(spark, sf_dir, "customer").select("c_custkey", payload.alias("payload"))).select("c_custkey", "masked")


PLACED = cases.FAMILIES["passport"][1] + cases.FAMILIES["address"][1]


def places_sql(sentences: list[str]) -> str:
    """(c_custkey, type, start, stop) of every marked value: the bytes before it are counted."""
    rows = []
    for i, x in enumerate(sentences):
        before = "''"
        for c, t in cases.pieces(x):
            if c:
                rows.append(f"SELECT c_custkey, '{c}' AS type, strlen({before})::INT AS start, strlen({before} || {text_sql(t)})::INT AS stop FROM customer WHERE c_custkey % {len(sentences)} = {i}")
            before += f" || {text_sql(t)}"
    return " UNION ALL ".join(rows)


@query(places_sql(PLACED))
def detect_offsets(spark, sf_dir):
    """Places and categories without values: byte offsets."""
    types = cases.FAMILIES["passport"][0] + cases.FAMILIES["address"][0]
    found = Engine(only(types)).detect(told(spark, sf_dir, PLACED)).select("c_custkey", F.explode("spans").alias("s"))
    return found.select("c_custkey", F.col("s.type").alias("type"), F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


@query("SELECT c_custkey, " + KEEP2.format(x="c_name") + " AS keep2, " + ALL.format(x="c_name") + " AS stars, regexp_replace(upper(c_name[1]), '$', '.') AS initials, 'PD_FIO_' || substr(sha256(concat('veilframe.v1.token', chr(0), c_name)), 1, 6) AS token FROM customer")
def mask_strategies(spark, sf_dir):
    name, kind = F.col("c_name"), F.lit("FIO")
    return table(spark, sf_dir, "customer").select("c_custkey", masks.stars_keep2(name, kind).alias("keep2"), masks.stars_all(name, kind).alias("stars"), masks.initials(name, kind).alias("initials"), masks.token(name, kind).alias("token"))


@query("SELECT s_suppkey, regexp_extract(v, '^([a-zA-Z0-9]{2})', 1) || regexp_replace(substr(split_part(v, '@', 1), 3), '[a-zA-Z0-9]', '*', 'g') || '@' || split_part(v, '@', 2) AS masked FROM (SELECT s_suppkey, concat('supplier', s_suppkey, '@example.com') AS v FROM supplier)")
def mask_keep_domain(spark, sf_dir):
    value = F.concat(F.lit("supplier"), F.col("s_suppkey").cast("string"), F.lit("@example.com"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", masks.keep_domain(value, F.lit("EMAIL")).alias("masked"))


def hex_sql(of: str, kind: str, blocks: int) -> str:
    """The hexadecimal digits of a value's counter stream in SQL."""
    return "(" + " || ".join(f"sha256(concat_ws(chr(0), 'veilframe', '{kind}', {of}, '{i}'))" for i in range(blocks)) + ")"


def number_sql(h: str, k: int, below: int) -> str:
    return f"(list_reduce(list_transform(string_split(substr({h}, {8 * k + 1}, 8), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT), lambda a, d: a * 16 + d) % {below})"


def digits_sql(h: str, count: int) -> str:
    return "(" + " || ".join(f"{number_sql(h, k, 10)}::VARCHAR" for k in range(count)) + ")"


FAKE_PHONE = "'79' || " + digits_sql("hp", 9)
FAKE_CARD = "'4' || " + digits_sql("hc", 14)
LUHN_SUM = "list_sum([CASE WHEN i % 2 = 1 THEN CASE WHEN c[16 - i]::INT > 4 THEN c[16 - i]::INT * 2 - 9 ELSE c[16 - i]::INT * 2 END ELSE c[16 - i]::INT END FOR i IN range(1, 16)])"


@query(
    "WITH v AS (SELECT c_custkey, '+7 916 ' || lpad((c_custkey % 10000000)::VARCHAR, 7, '0') AS phone, '4111 1111 11' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || ' 1111' AS card, c_name FROM customer), "
    f"h AS (SELECT *, {hex_sql('phone', 'PHONE', 2)} AS hp, {hex_sql('card', 'CARD_NUMBER', 3)} AS hc, {hex_sql('c_name', 'EMAIL', 1)} AS he FROM v), "
    f"m AS (SELECT c_custkey, {FAKE_PHONE} AS p, {FAKE_CARD} AS c, {number_sql('he', 0, 100000)} AS e FROM h), "
    f"d AS (SELECT *, c || ((10 - ({LUHN_SUM}) % 10) % 10)::VARCHAR AS c16 FROM m) "
    "SELECT c_custkey, '+' || p[1] || ' ' || p[2:4] || ' ' || p[5:11] AS phone, c16[1:4] || ' ' || c16[5:8] || ' ' || c16[9:12] || ' ' || c16[13:16] AS card, 'user' || lpad(e::VARCHAR, 5, '0') || '@example.com' AS email FROM d"
)
def mask_synthetic(spark, sf_dir):
    """Made-up phones, cards and addresses: the counter stream, digits where they stood, a valid check digit."""
    from veilframe.functions.synthetic import synthetic

    key = F.col("c_custkey")
    phone = F.concat(F.lit("+7 916 "), F.lpad((key % 10000000).cast("string"), 7, "0"))
    card = F.concat(F.lit("4111 1111 11"), F.lpad((key % 100).cast("string"), 2, "0"), F.lit(" 1111"))
    fake = lambda v, kind: synthetic(v, F.lit(kind))
    return table(spark, sf_dir, "customer").select("c_custkey", fake(phone, "PHONE").alias("phone"), fake(card, "CARD_NUMBER").alias("card"), fake(F.col("c_name"), "EMAIL").alias("email"))


@query(
    "WITH t AS (SELECT o_orderkey, lpad(((o_orderkey * 7919 + 13) % 10000000000)::VARCHAR, 10, '0') AS n10, lpad(((o_orderkey * 104729 + 7) % 100000000000)::VARCHAR, 11, '0') AS n11, lpad((4000000000000000 + o_orderkey * 15485863)::VARCHAR, 16, '0') AS n16 FROM orders) "
    "SELECT o_orderkey, (list_sum([n10[i]::INT * [2, 4, 10, 3, 5, 9, 4, 6, 8][i] FOR i IN range(1, 10)]) % 11 % 10 = n10[10]::INT AND NOT length(replace(n10, n10[1], '')) = 0) AS inn, "
    "((CASE WHEN list_sum([n11[i]::INT * (10 - i) FOR i IN range(1, 10)]) % 101 = 100 THEN 0 ELSE list_sum([n11[i]::INT * (10 - i) FOR i IN range(1, 10)]) % 101 END) = substr(n11, 10, 2)::INT) AS snils, "
    + LUHN.format(x="n16")
    + " AS luhn FROM t"
)
def checksums(spark, sf_dir):
    key = F.col("o_orderkey")
    n10 = F.lpad(((key * 7919 + 13) % 10000000000).cast("string"), 10, "0")
    n11 = F.lpad(((key * 104729 + 7) % 100000000000).cast("string"), 11, "0")
    n16 = F.lpad((F.lit(4000000000000000) + key * 15485863).cast("string"), 16, "0")
    return table(spark, sf_dir, "orders").select("o_orderkey", checks.inn_valid(n10).alias("inn"), checks.snils_valid(n11).alias("snils"), checks.luhn(n16).alias("luhn"))


@query(r"SELECT doc_id, strlen(text) AS n_bytes, len(regexp_extract_all(text, '(?s)\s+|[\p{L}\p{Nd}_]+|.')) AS n_tokens, (lower(text) = text) AS blind, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS estimate FROM documents")
def text_measures(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    parts = F.regexp_extract_all("text", F.lit(rf"(?s)\s+|{text.WORD}+|."), F.lit(0))
    return docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.size(parts).cast("long").alias("n_tokens"), text.case_blind("text").alias("blind"), text.estimate_tokens("text").cast("long").alias("estimate"))


@query(r"SELECT item_id, sum(strlen(t)) AS n_bytes, count(*) FILTER (regexp_matches(t, '^[\p{L}_]+$')) AS words, count(*) FILTER (regexp_matches(t, '^\s')) AS spaces FROM (SELECT item_id, unnest(regexp_extract_all(text, '(?s)\s+|[\p{L}\p{Nd}_]+|.')) AS t FROM benchmark) GROUP BY item_id")
def text_tokens(spark, sf_dir):
    """Tokens with byte offsets: the last end is the text's length."""
    made = table(spark, sf_dir, "benchmark").select("item_id", text.tokens("text").alias("t"))
    kinds = lambda k: F.size(F.filter("t", lambda x: x["kind"] == k)).cast("long")
    return made.select("item_id", F.element_at("t", -1)["end"].cast("long").alias("n_bytes"), kinds("word").alias("words"), kinds("space").alias("spaces"))


@query()
def text_chunks(spark, sf_dir):
    """Long documents as chunks of bounded size."""
    parts = explode_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 4096, 64)
    return parts.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("chunk")).alias("longest"))


def step_sql(name: str, before: str, key: str, pattern: str, mark: str) -> str:
    """A step of scrubbing in SQL: the pieces between the matches and, in their places, the digits of the matches."""
    p = pattern.replace("'", "''")
    return (
        f"{name} AS (SELECT {key}, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i <= len(m) THEN '[{mark}:' || length(regexp_replace(m[i], '[^0-9]', '', 'g')) || ' redacted]' ELSE '' END), '') AS t "
        f"FROM (SELECT {key}, regexp_split_to_array(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m FROM {before}))"
    )


def scrub_sql(source: str, key: str) -> str:
    """CTEs that scrub t of source (key, t); the last is `scrubbed`."""
    steps = [f"s0 AS (SELECT {key}, regexp_replace(t, '{scrub.EMAIL}', '[email redacted]', 'g') AS t FROM ({source}))"]
    for i, (pattern, mark) in enumerate(((scrub.PHONE, "phone"), (scrub.GROUPED, "digits"), (scrub.LONG, "digits"))):
        steps.append(step_sql(f"s{i + 1}", f"s{i}", key, pattern, mark))
    names = scrub.NAMES.replace("\\u00a0", "\u00a0")
    return ", ".join([*steps, f"scrubbed AS (SELECT {key}, regexp_replace(t, '{names}', '[name redacted]', 'g') AS t FROM s3)"])


LINES = "SELECT c_custkey, concat('segment ', lower(c_mktsegment), CASE c_custkey % 6 WHEN 0 THEN ' ' || c_name WHEN 1 THEN ' +7 916 555-44-33' WHEN 2 THEN ' card 4111 1111 1111 1111 ok' WHEN 3 THEN ' Ivan Petrov' WHEN 4 THEN ' user' || c_custkey || '@mail.example.ru and a long tail of words about the request that failed' ELSE ' id 12345' END) AS t FROM customer"


@query(
    f"WITH v AS ({LINES}), {scrub_sql('SELECT * FROM v', 'c_custkey')} "
    r"SELECT c_custkey, CASE WHEN length(scrubbed.t) > 64 OR regexp_matches(scrubbed.t, '\p{Nd}{4}') OR regexp_matches(scrubbed.t, '\p{Lu}\p{L}+[ .]+\p{Lu}\p{L}+') THEN concat('[redacted len=', length(v.t), ' fp=', substr(sha256(concat('s', v.t)), 1, 8), ']') ELSE scrubbed.t END AS line FROM v JOIN scrubbed USING (c_custkey)"
)
def scrub_redact(spark, sf_dir):
    """Values of log lines: scrubbed, or only their length and fingerprint."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer_lines")
    lines = spark.sql(LINES.replace("FROM customer", "FROM customer_lines"))
    return lines.select("c_custkey", scrub.redact_value("t", "s").alias("line"))


@query(f"WITH {scrub_sql('SELECT doc_id, text AS t FROM documents', 'doc_id')} SELECT doc_id, t AS line FROM scrubbed")
def scrub_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scrub.scrub("text").alias("line"))


@query(
    "WITH s AS (SELECT DISTINCT l_suppkey // 4 AS key, CASE WHEN l_linenumber % 2 = 0 THEN (l_orderkey * 7 % 500) * 100 ELSE (l_orderkey % 5000) * 10 END AS a, CASE WHEN l_linenumber % 2 = 0 THEN 60 ELSE 8 END AS n FROM lineitem), "
    "k AS (SELECT * FROM s x WHERE n = 60 OR NOT EXISTS (SELECT 1 FROM s y WHERE y.key = x.key AND y.n = 60 AND x.a < y.a + 60 AND y.a < x.a + x.n)) "
    "SELECT key, count(*) AS kept, sum(a)::BIGINT AS starts, sum(n)::BIGINT AS bytes, count(*) FILTER (n = 60) AS long FROM k GROUP BY key"
)
def resolve_dense(spark, sf_dir):
    """Over a thousand overlapping spans in each row, with copies: long ones win, short ones fill what is left."""
    li = table(spark, sf_dir, "lineitem")
    long_ = F.col("l_linenumber") % 2 == 0
    start = F.when(long_, (F.col("l_orderkey") * 7 % 500) * 100).otherwise((F.col("l_orderkey") % 5000) * 10).cast("int")
    kind = F.when(long_, "FIO").otherwise("CITY")
    one = F.struct(start.alias("start"), (start + F.when(long_, 60).otherwise(8)).alias("end"), kind.alias("type"), F.lit(0.9).alias("conf"), F.lit("query").alias("src"), F.lit("").alias("hint"))
    rows = li.groupBy(F.floor(F.col("l_suppkey") / 4).cast("long").alias("key")).agg(F.collect_list(one).alias("spans"))
    made = rows.select("key", F.explode(S.resolve(F.col("spans"))).alias("s")).withColumn("n", F.col("s.end") - F.col("s.start"))
    return made.groupBy("key").agg(F.count("*").alias("kept"), F.sum("s.start").alias("starts"), F.sum("n").alias("bytes"), F.sum((F.col("n") == 60).cast("long")).alias("long"))


def found_spans(spark, sf_dir) -> DataFrame:
    """(key, system_id, type, start, end, conf): one span for each line item, as if detected."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ["EMAIL", "PHONE", "CVV", "CARD_NUMBER"])), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return li.select(
        F.col("l_orderkey").alias("key"),
        F.when(F.col("l_linenumber") % 2 == 0, "default").otherwise("analytics").alias("system_id"),
        kind.alias("type"),
        (F.col("l_linenumber") * 10).alias("start"),
        (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int") % 25 + 1).alias("end"),
        (F.col("l_discount") * 10).alias("conf"),
    )


SPANS_SQL = "(SELECT l_orderkey AS key, CASE WHEN l_linenumber % 2 = 0 THEN 'default' ELSE 'analytics' END AS system_id, ['EMAIL', 'PHONE', 'CVV', 'CARD_NUMBER'][l_suppkey % 4 + 1] AS type, l_linenumber * 10 AS start, l_linenumber * 10 + l_quantity::INT % 25 + 1 AS stop, l_discount * 10 AS conf FROM lineitem)"


@query(
    f"WITH s AS {SPANS_SQL}, p AS (SELECT * FROM s WHERE conf >= CASE WHEN system_id = 'analytics' AND type = 'PHONE' THEN 0.8 ELSE 0.7 END AND NOT (system_id = 'analytics' AND type = 'EMAIL')) "
    "SELECT system_id, type, count(*) AS n FROM p WHERE type <> 'CVV' OR EXISTS (SELECT 1 FROM p q WHERE q.key = p.key AND q.type = 'CARD_NUMBER') GROUP BY system_id, type"
)
def rules_semi_join(spark, sf_dir):
    """Rule filter and companion rule as broadcast and EXISTS semi joins."""
    c = C.default()
    for s in c.systems:
        s.types["CVV"].requires_companion = ["CARD_NUMBER"]
    analytics = next(s for s in c.systems if s.id == "analytics")
    analytics.types["EMAIL"].enabled, analytics.types["PHONE"].min_confidence = False, 0.8
    return S.semi_join_rules(found_spans(spark, sf_dir), C.rules_table(spark, c)).groupBy("system_id", "type").agg(F.count("*").alias("n"))


@query(f"WITH s AS {SPANS_SQL} SELECT a.type, count(*) AS n FROM s a WHERE a.conf > 0.5 AND NOT EXISTS (SELECT 1 FROM s m WHERE m.conf <= 0.5 AND m.key = a.key AND a.start < m.stop AND m.start < a.stop) GROUP BY a.type")
def leak_anti_join(spark, sf_dir):
    """Spans that no mask overlaps: an interval anti join by key."""
    spans = found_spans(spark, sf_dir)
    covers = spans.where("conf <= 0.5").select("key", F.col("start").alias("mask_start"), F.col("end").alias("mask_end"))
    return S.interval_anti_join(spans.where("conf > 0.5"), covers).groupBy("type").agg(F.count("*").alias("n"))


@query(
    f"WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start - stop, -(CASE type WHEN 'EMAIL' THEN 88 WHEN 'PHONE' THEN 85 WHEN 'CVV' THEN 40 ELSE 100 END), -conf, start) AS turn FROM {SPANS_SQL}), "
    "k(key, turn, kept) AS (SELECT key, 0::BIGINT, []::STRUCT(a INT, b INT)[] FROM (SELECT DISTINCT key FROM s) UNION ALL "
    "SELECT k.key, s.turn, CASE WHEN len(list_filter(kept, lambda x: x.a < s.stop AND s.start < x.b)) > 0 THEN kept ELSE list_append(kept, {'a': s.start::INT, 'b': s.stop::INT}) END FROM k JOIN s ON s.key = k.key AND s.turn = k.turn + 1) "
    "SELECT key, max(turn)::INT AS n_raw, max_by(len(kept), turn)::INT AS n_kept FROM k GROUP BY key"
)
def resolve_spans(spark, sf_dir):
    """Overlap resolution of each order's spans."""
    made = found_spans(spark, sf_dir).select("key", F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "type", "conf", F.lit("t").alias("src"), F.lit("").alias("hint")).alias("s"))
    grouped = made.groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    return grouped.select("key", F.size("spans").alias("n_raw"), F.size(S.resolve("spans")).alias("n_kept"))


def requests(spark, sf_dir) -> DataFrame:
    """Traffic: events as requests of five systems."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "click", "mask").when(F.col("event_type") == "view", "demask").otherwise(F.col("event_type"))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("system_id"), op.alias("op"), (F.col("event_id") % 3 * 100 + 200).alias("status"), F.col("value").alias("latency_ms"))


REQUESTS_SQL = "(SELECT event_id, ts, 's' || (user_id % 5) AS system_id, CASE event_type WHEN 'click' THEN 'mask' WHEN 'view' THEN 'demask' ELSE event_type END AS op, event_id % 3 * 100 + 200 AS status, value AS latency_ms FROM events)"
BUCKET_SQL = "coalesce(" + ", ".join(f"CASE WHEN latency_ms <= {b} THEN {b}.0 END" for b in metrics.BOUNDS) + ", 'inf'::DOUBLE)"
HIST_SQL = f"(SELECT b.le, count(r.le) AS n, sum(count(r.le)) OVER (ORDER BY b.le) AS cumulative FROM (SELECT unnest([{', '.join(f'{b}.0::DOUBLE' for b in metrics.BOUNDS)}, 'inf'::DOUBLE]) AS le) b LEFT JOIN (SELECT {BUCKET_SQL}::DOUBLE AS le FROM {REQUESTS_SQL} WHERE latency_ms IS NOT NULL) r ON r.le = b.le GROUP BY b.le)"


@query(f"SELECT CASE WHEN op IN ('mask', 'demask', 'again', 'echo') THEN op ELSE 'other' END AS op, status, count(*) AS n FROM {REQUESTS_SQL} GROUP BY 1, 2")
def metric_requests(spark, sf_dir):
    return metrics.request_counts(requests(spark, sf_dir))


@query(f"SELECT CASE WHEN le = 'inf'::DOUBLE THEN NULL ELSE le END AS le, n, cumulative::BIGINT AS cumulative FROM {HIST_SQL}")
def metric_histogram(spark, sf_dir):
    return metrics.histogram(requests(spark, sf_dir), "latency_ms")


@query(f"SELECT min(le) AS quantile FROM {HIST_SQL} WHERE cumulative >= greatest(1, floor(0.95 * (SELECT count(latency_ms) FROM {REQUESTS_SQL})))")
def metric_quantile(spark, sf_dir):
    return metrics.bucket_quantile(metrics.histogram(requests(spark, sf_dir), "latency_ms"), 0.95)


@query(f"SELECT quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.9) AS p90, quantile_cont(latency_ms, 0.95) AS p95, quantile_cont(latency_ms, 0.99) AS p99, max(latency_ms) AS max FROM {REQUESTS_SQL}")
def metric_percentiles(spark, sf_dir):
    return metrics.percentiles(requests(spark, sf_dir), "latency_ms")


@query(f"WITH c AS (SELECT floor(epoch(ts))::BIGINT AS second, count(*) AS n FROM {REQUESTS_SQL} GROUP BY 1) SELECT a.second, sum(b.n) / 10.0 AS rate FROM c a JOIN c b ON b.second BETWEEN a.second - 9 AND a.second GROUP BY a.second")
def metric_rates(spark, sf_dir):
    return metrics.rates(requests(spark, sf_dir))


@query(f"SELECT system_id, count(*) AS n, count(*) FILTER (allowed) AS allowed FROM (SELECT system_id, count(*) OVER (PARTITION BY system_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) <= 2 AS allowed FROM {REQUESTS_SQL}) GROUP BY system_id")
def metric_rate_limit(spark, sf_dir):
    out = metrics.limited(requests(spark, sf_dir), 2)
    return out.groupBy("system_id").agg(F.count("*").alias("n"), F.sum(F.col("allowed").cast("long")).alias("allowed"))


@query(f"SELECT system_id, type, count(*) AS n FROM {SPANS_SQL} GROUP BY ROLLUP (system_id, type)")
def metric_rollup(spark, sf_dir):
    made = found_spans(spark, sf_dir).select("system_id", F.array(F.struct("type")).alias("replacements"))
    return metrics.rollup_report(made)


@query(
    f"SELECT key, expires FROM (SELECT event_id::VARCHAR AS key, ts AS expires, row_number() OVER (PARTITION BY ('0x' || md5(event_id::VARCHAR)[1:6])::BIGINT % 64 ORDER BY ts DESC, event_id::VARCHAR) AS n FROM {REQUESTS_SQL}) WHERE n > 10"
)
def metric_evicted(spark, sf_dir):
    entries = requests(spark, sf_dir).select(F.col("event_id").cast("string").alias("key"), F.col("ts").alias("expires"))
    return metrics.evicted(entries, 640)


@query(f"SELECT event_id, system_id FROM (SELECT event_id, system_id, row_number() OVER (PARTITION BY system_id ORDER BY event_id) AS n FROM {REQUESTS_SQL}) WHERE n % 10 = 0")
def metric_log_sample(spark, sf_dir):
    return scrub.sampled(requests(spark, sf_dir), 10, "event_id").select("event_id", "system_id")


MAPPED = "(SELECT 'id' || o_orderkey AS key, 'order ' || o_orderkey AS original, 'or*** ' || o_orderkey AS masked FROM orders WHERE o_orderkey % 3 = 0)"


@query(
    "WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'or*** ' || o_orderkey WHEN 1 THEN 'order ' || o_orderkey WHEN 2 THEN 'x**y' ELSE 'plain' END AS payload FROM orders) "
    f"SELECT CASE WHEN m.key IS NULL THEN CASE WHEN contains(payload, '**') THEN 'echo' ELSE 'mask' END WHEN payload = m.masked THEN 'demask' WHEN payload = m.original THEN 'again' ELSE 'mask' END AS operation, count(*) AS n FROM r LEFT JOIN {MAPPED} m ON m.key = 'id' || o_orderkey GROUP BY 1"
)
def demask_decide(spark, sf_dir):
    """What each payload asks for, by a join with the mapping."""
    orders = table(spark, sf_dir, "orders")
    key, number = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    mapping = orders.where(key % 3 == 0).select(F.concat(F.lit("id"), number).alias("key"), F.concat(F.lit("order "), number).alias("original"), F.concat(F.lit("or*** "), number).alias("known"))
    payload = F.when(key % 4 == 0, F.concat(F.lit("or*** "), number)).when(key % 4 == 1, F.concat(F.lit("order "), number)).when(key % 4 == 2, "x**y").otherwise("plain")
    asked = orders.select(text.store_key(F.concat(F.lit(" ID"), number)).alias("key"), payload.alias("payload"))
    joined = asked.join(mapping, "key", "left")
    return joined.groupBy(S.decide(F.col("original"), F.col("known"), F.col("payload")).alias("operation")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, text AS restored FROM documents")
def demask_round_trip(spark, sf_dir):
    """Masking and restoring every document gives its text."""
    out = Engine(C.default()).mask(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", S.restore("masked", F.col("replacements")).alias("restored"))


@query("SELECT conv_id, 200 AS status, 'You wrote: ' || coalesce(last(text ORDER BY turn) FILTER (role = 'user'), '') AS restored, count(*) AS n FROM conversations GROUP BY conv_id")
def chat_conversations(spark, sf_dir):
    """Conversations masked, guarded, answered and restored."""
    out = Engine(C.default()).chat(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "status", "restored", F.size("messages").cast("long").alias("n"))


WANTED = "list_extract([" + ", ".join(str(len(cases.categories(x))) for x in EVERY) + f"], (c_custkey % {len(EVERY)})::INT + 1)"


@query(f"SELECT sum({WANTED})::BIGINT AS expected, sum({WANTED})::BIGINT AS hit, count(*) FILTER ({WANTED} = 0) AS negatives, count(*) FILTER ({WANTED} = 0) AS clean, 1.0::DOUBLE AS restore_ratio, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS clean_ratio FROM customer")
def quality_ratios(spark, sf_dir):
    """Recall, untouched negatives and exact restoring over all families' sentences, by all thirty categories at once."""
    made = told(spark, sf_dir, EVERY)
    types = F.array(*[F.array(*map(F.lit, cases.categories(x))).cast("array<string>") for x in EVERY])
    wanted = made.select(F.col("c_custkey").alias("id"), F.element_at(types, F.col("turn") + 1).alias("expect_types"))
    masked = Engine(C.default()).mask(made)
    found = masked.select(F.col("c_custkey").alias("id"), "types", (F.col("masked") == F.col("payload")).alias("unchanged"), (S.restore("masked", F.col("replacements")) == F.col("payload")).alias("restored"))
    return metrics.quality(wanted, found)


@query(
    f"WITH s AS (SELECT key, start, conf > 0.5 AS sure FROM {SPANS_SQL}) "
    "SELECT b.key, b.start, min_by(a.start, abs(a.start - b.start) * 1000 + a.start) AS near_start FROM s b LEFT JOIN s a ON a.key = b.key AND a.sure AND abs(a.start - b.start) <= 30 WHERE NOT b.sure GROUP BY b.key, b.start"
)
def nearest_join(spark, sf_dir):
    """Each weak finding with the nearest sure one of its payload, at most thirty bytes away."""
    spans = found_spans(spark, sf_dir).select("key", "start", "conf")
    near = relational.nearest(spans.where("conf <= 0.5").select("key", "start"), spans.where("conf > 0.5"), "key", "start", [], cell=64, within=30)
    return near.select("key", "start", F.col("near.at").cast("int").alias("near_start")).distinct()


@query(f"SELECT op, status, grouping(op, status) AS level, count(*) AS n FROM {REQUESTS_SQL} GROUP BY CUBE (op, status)")
def metric_cube(spark, sf_dir):
    return metrics.cube_report(requests(spark, sf_dir))


@query(f"SELECT event_id, latency_ms FROM {REQUESTS_SQL} ORDER BY latency_ms DESC NULLS LAST, event_id LIMIT 25")
def metric_slowest(spark, sf_dir):
    return metrics.slowest(requests(spark, sf_dir), 25).select("event_id", "latency_ms")


@query("(SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'view') EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 150 UNION SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 300")
def user_sets(spark, sf_dir):
    """Users who masked and restored, less those with a large error, and all with a large purchase: set operators."""
    e = table(spark, sf_dir, "events")
    of = lambda kind: e.where(F.col("event_type") == kind)
    both = of("click").select("user_id").intersect(of("view").select("user_id")).subtract(of("error").where("value > 150").select("user_id"))
    return both.union(of("purchase").where("value > 300").select("user_id")).distinct()


@query("SELECT event_type, count(*) AS n, sum((props ->> '$.k')::BIGINT)::BIGINT AS total, max((props ->> '$.k')::BIGINT) AS highest FROM events GROUP BY event_type")
def json_properties(spark, sf_dir):
    """Numbers out of JSON properties, by a schema."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max("k").alias("highest"))


WRITTEN = "CASE o_orderkey % 3 WHEN 0 THEN concat(o_orderkey % 32, '.', o_orderkey % 14, '.', 1950 + o_orderkey % 90) WHEN 1 THEN concat(1950 + o_orderkey % 90, '-', o_orderkey % 14, '-', o_orderkey % 32) ELSE concat(o_orderkey % 32, '/', o_orderkey % 14, '/', lpad({year}, 2, '0')) END"


@query(
    f"WITH t AS (SELECT o_orderkey, {WRITTEN.format(year='(o_orderkey % 100)::VARCHAR')} AS written, o_orderkey % 32 AS d, o_orderkey % 14 AS m, "
    "CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey % 100 + CASE WHEN o_orderkey % 100 <= 25 THEN 2000 ELSE 1900 END ELSE 1950 + o_orderkey % 90 END AS y FROM orders) "
    "SELECT o_orderkey, written, try_strptime(concat(y, '-', lpad(m::VARCHAR, 2, '0'), '-', lpad(d::VARCHAR, 2, '0')), '%Y-%m-%d')::DATE AS day FROM t"
)
def written_dates(spark, sf_dir):
    """Dates as they are written, null where the calendar has none."""
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(WRITTEN.format(year="cast(o_orderkey % 100 as string)")).alias("written"))
    return made.withColumn("day", calendar.numeric_date("written", 2025))


@query()
def text_chunks_udtf(spark, sf_dir):
    """The same chunks as text_chunks by the table function, in SQL."""
    register_chunks(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("chunked_documents")
    return spark.sql("SELECT doc_id AS key, count(*) AS n, max(octet_length(chunk)) AS longest FROM chunked_documents, LATERAL text_chunks(text, 4096, 64) GROUP BY doc_id")


@query(f"SELECT doc_id, len({EMAILS}) AS emails FROM documents")
def detect_long_documents(spark, sf_dir):
    """E-mail addresses of documents that are scanned as chunks of their own rows."""
    found = detect_long(table(spark, sf_dir, "documents"), "doc_id", "text", ["EMAIL"], size=2048)
    return found.select(F.col("key").alias("doc_id"), F.size(F.filter("spans", lambda x: x["type"] == "EMAIL")).cast("long").alias("emails"))


def priced(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Intervals without a common key: of orders over part numbers, and of parts."""
    start = F.col("o_custkey") * 2
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", start.alias("start"), (start + F.col("o_orderkey") % 7).alias("stop"))
    size = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")).otherwise(1)
    return orders, table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("begin"), (F.col("p_partkey") + size).alias("finish"))


INTERVALS = "a AS (SELECT o_orderkey, o_orderpriority, o_custkey * 2 AS start, o_custkey * 2 + o_orderkey % 7 AS stop FROM orders), b AS (SELECT p_partkey, p_partkey AS begin, p_partkey + CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE 1 END AS finish FROM part)"
OVERLAP = "a.start < b.finish AND b.begin < a.stop"


@query(f"WITH {INTERVALS} SELECT o_orderpriority, count(*) AS n, count(p_partkey) AS pairs, sum(CASE WHEN p_partkey IS NOT NULL THEN least(stop, finish) - greatest(start, begin) END)::BIGINT AS shared FROM a LEFT JOIN b ON {OVERLAP} GROUP BY o_orderpriority")
def interval_pairs(spark, sf_dir):
    """All overlapping pairs, and the orders without any: a left join by overlap alone."""
    met = relational.interval_join(*priced(spark, sf_dir), how="left")
    shared = F.least("stop", "finish") - F.greatest("start", "begin")
    return met.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count("p_partkey").alias("pairs"), F.sum(F.when(F.col("p_partkey").isNotNull(), shared)).cast("long").alias("shared"))


@query(f"WITH {INTERVALS} SELECT o_orderpriority, EXISTS (SELECT 1 FROM b WHERE {OVERLAP}) AS met, count(*) AS n FROM a GROUP BY 1, 2")
def interval_exists(spark, sf_dir):
    """Which orders overlap any part: semi and anti joins."""
    a, b = priced(spark, sf_dir)
    parts = [relational.interval_join(a, b, how).withColumn("met", F.lit(how == "left_semi")) for how in ("left_semi", "left_anti")]
    return parts[0].unionByName(parts[1]).groupBy("o_orderpriority", "met").agg(F.count("*").alias("n"))


GAMMA = metrics.gamma(0.01)


@query(
    f"WITH b AS (SELECT system_id, ceil(ln(least(greatest(latency_ms, {metrics.LOW}), {metrics.HIGH})) / ln({GAMMA!r}::DOUBLE))::INT AS bucket, count(*) AS n FROM {REQUESTS_SQL} WHERE latency_ms IS NOT NULL GROUP BY 1, 2), "
    "u AS (SELECT *, sum(n) OVER (PARTITION BY system_id ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY system_id) AS total FROM b) "
    f"SELECT system_id, q AS quantile, round(pow({GAMMA!r}::DOUBLE, bucket) * {2 / (GAMMA + 1)!r}::DOUBLE, 6) AS estimate FROM u, (SELECT unnest([0.5, 0.9, 0.99]::DOUBLE[]) AS q) WHERE upto > floor(q * (total - 1)) AND upto - n <= floor(q * (total - 1))"
)
def metric_sketch(spark, sf_dir):
    """Latency quantiles by system, within one percent: sketches by system and hour, merged."""
    hourly = metrics.sketch(requests(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts")), "latency_ms", ["system_id", "hour"])
    found = metrics.sketch_quantiles(metrics.merged(hourly, ["system_id"]), ["system_id"], [0.5, 0.9, 0.99])
    return found.select("system_id", "quantile", F.round("estimate", 6).alias("estimate"))


WORDS = r"'[\p{L}\p{Nd}_]+(?:-[\p{L}\p{Nd}_]+)*'"


@query(
    f"WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {WORDS})) AS entry FROM benchmark), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {WORDS})) AS entry FROM documents) "
    "SELECT doc_id, count(*) AS n, sum(strlen(entry))::BIGINT AS bytes FROM w JOIN d USING (entry) WHERE length(entry) >= 6 GROUP BY doc_id"
)
def dictionary_words(spark, sf_dir):
    """Words of a dictionary table - the long ones of the benchmark - in all documents."""
    listed = F.explode(F.transform(dictionary.phrases("text", 1), lambda p: p["entry"]))
    words = table(spark, sf_dir, "benchmark").select(listed.alias("entry")).where("length(entry) >= 6").select("entry", F.lit("TERM").alias("kind")).distinct()
    found = dictionary.entries(table(spark, sf_dir, "documents"), "doc_id", "text", words, words=1)
    return found.select(F.col("key").alias("doc_id"), F.size("spans").cast("long").alias("n"), F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("bytes"))
