import pytest
from pyspark.sql import functions as F

from veilframe.operators import spans as S
from veilframe.plans import config as C
from veilframe.plans.engine import Engine

ROWS = [
    ("p1", "Клиент Сидоров Пётр Петрович, паспорт 4509 123456, тел. +7 916 123-45-67, почта s.petr@mail.ru", "default"),
    ("p2", "Карта 4111 1111 1111 1111, CVV 123", "analytics"),
    ("p3", "", None),
    ("p4", None, "default"),
    ("P1 ", "ничего личного", "unknown"),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "payload_id string, payload string, system_id string").cache()


@pytest.fixture(scope="module")
def masked(table):
    return Engine(C.default()).mask(table).cache()


def test_masks(masked):
    got = {r.payload_id: r.masked for r in masked.collect()}
    assert got["p1"] == "Клиент С. П. П., паспорт 45** ****56, тел. +7 9** ***-**-67, почта s.p***@****.ru"
    assert got["p2"] == "Карта 41** **** **** **11, CVV ***"
    assert got["p3"] == "" and got["p4"] is None and got["P1 "] == "ничего личного"


def test_restoring_is_exact(masked):
    back = masked.where("payload is not null").select("payload", S.restore("masked", F.col("replacements")).alias("r")).collect()
    assert all(r.payload == r.r for r in back)


@pytest.mark.parametrize("preset", C.PRESETS)
def test_presets_restore_and_never_leak(table, preset):
    out = Engine(C.preset(preset)).mask(table).where("payload is not null")
    for r in out.select("payload", "masked", "types", S.restore("masked", F.col("replacements")).alias("r")).collect():
        assert r.payload == r.r
        assert ("4509 123456" not in r.masked) and ("4111 1111" not in r.masked)


def test_demask_directions(masked, table):
    e = Engine(C.default())
    mapping = e.mapping(masked)
    assert {r.key for r in mapping.collect()} == {"p1"}  # analytics may not restore
    ask = masked.select("payload_id", F.col("masked").alias("payload"), "system_id").where("payload is not null")
    got = {r.payload_id: (r.operation, r.result) for r in e.demask(ask, mapping).collect()}
    assert got["p1"] == ("demask", ROWS[0][1])
    assert got["p2"][0] == "echo" and got["p3"] == ("mask", "") and got["P1 "][0] == "mask"
    again = {r.payload_id: r.operation for r in e.demask(table, mapping).collect()}
    assert again["p1"] == "again"


def test_rules_floor_companion_and_custom(spark, table):
    c = C.default()
    c.systems[0].types["CVV"].requires_companion = ["CARD_NUMBER"]
    c.systems[0].types["PHONE"].min_confidence = 0.99
    c.systems[0].types["FIO"].enabled = False
    c.custom_types = [C.CustomType("ORDER_NO", r"A-[0-9]{4}", ["заказ"], 20, "label", "[ЗАКАЗ]")]
    rows = [("1", "CVV 123, заказ A-1234, A-9999 тел. +7 916 123-45-67"), ("2", "карта 4111 1111 1111 1111 CVV 123"), ("3", "Клиент Сидоров Пётр Петрович")]
    got = {r.payload_id: r.masked for r in Engine(c).mask(spark.createDataFrame(rows, "payload_id string, payload string").withColumn("system_id", F.lit("default"))).collect()}
    assert got["1"] == "CVV 123, заказ [ЗАКАЗ], [ЗАКАЗ] тел. +7 916 123-45-67" or got["1"] == "CVV 123, заказ [ЗАКАЗ], A-9999 тел. +7 916 123-45-67"
    assert got["2"] == "карта 41** **** **** **11 CVV ***"
    assert got["3"] == rows[2][1]


def test_long_documents_by_rules(spark):
    c = C.default()
    c.chunk_bytes, c.systems[0].types["PHONE"].enabled = 900, False
    rows = [("a", "слово почта ivan.p@mail.ru, тел. +7 916 123-45-67. " * 100), ("b", "ничего"), ("c", None)]
    df = spark.createDataFrame(rows, "payload_id string, payload string")
    long_ = {r.key: [tuple(s) for s in r.spans] for r in Engine(c).detect_long(df, "payload_id").collect()}
    whole = {r.payload_id: [tuple(s) for s in r.spans or []] for r in Engine(c).detect(df).collect()}
    assert long_ == whole and len(long_["a"]) == 100


def test_relational_rules_equal_the_column_form(spark, masked):
    e = Engine(C.default())
    raw = e.detect(spark.createDataFrame(ROWS, "payload_id string, payload string, system_id string"))
    exploded = raw.where("payload is not null").select(F.col("payload_id").alias("key"), F.lit("default").alias("system_id"), F.explode("spans").alias("s")).select("key", "system_id", "s.*")
    kept = S.semi_join_rules(exploded, C.rules_table(spark, C.default()))
    assert kept.count() == exploded.count() > 0


def test_chat_masks_answers_and_restores(spark):
    talk = [(1, 0, "user", "Я Сидоров Пётр Петрович, почта s.petr@mail.ru"), (1, 1, "assistant", "ок"), (1, 2, "user", "Пишите на s.petr@mail.ru"), (2, 0, "user", None)]
    got = {r.conv_id: r for r in Engine(C.default()).chat(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].status == 200 and "s.petr" not in str(got[1].messages) and "PD_EMAIL_" in got[1].answer
    assert got[1].restored == "You wrote: Пишите на s.petr@mail.ru"
    assert got[1].counts == {"FIO": 1, "EMAIL": 2} and got[2].restored == "You wrote: "


def test_leak_guard_quarantines(spark):
    e = Engine(C.default())
    row = spark.createDataFrame([("почта a.bcd@mail.ru",)], "masked string").withColumn("replacements", F.array().cast("array<struct<type:string,orig_start:int,orig_end:int,mask_start:int,mask_end:int,original:string,masked:string>>"))
    assert [x.type for x in e.leak_guard(row).first().leaks] == ["EMAIL"]


def test_restore_text_skips_ambiguous_masks(spark):
    reps = [("**", "a"), ("**", "b"), ("PD_1", "Пётр"), ("PD_12", "Иван")]
    df = spark.createDataFrame([("PD_12 и PD_1 и **", [{"masked": m, "original": o} for m, o in reps])], "t string, r array<struct<masked:string,original:string>>")
    assert df.select(S.restore_text("t", F.col("r")).alias("x")).first().x == "Иван и Пётр и **"


def test_config_files_and_validation(tmp_path):
    c = C.default()
    c.custom_types = [C.CustomType("BADGE", "B[0-9]{4}")]
    path = tmp_path / "c.json"
    C.save(c, str(path))
    assert C.load(str(path)) == c and C.load(str(tmp_path / "none.json")) == C.default()
    for bad in (C.CustomType("badge", "x"), C.CustomType("EMAIL", "x"), C.CustomType("OK_", "(a+)+b"), C.CustomType("OK_", "(?=x)y"), C.CustomType("OK_", "x", window=500), C.CustomType("OK_", "["), C.CustomType("OK_", "x*")):
        assert C.problems(C.Config(systems=C.default().systems, custom_types=[bad]))
    c.systems[0].types["FIO"].requires_companion = ["BADGE"]
    assert C.problems(c)
    hidden = C.redacted(C.Config(systems=[C.System("a", api_key="k")]))
    assert hidden["systems"][0]["api_key"] == "***"
    assert C.with_secrets(C.from_dict(hidden), C.Config(systems=[C.System("a", api_key="k")])).systems[0].api_key == "k"
