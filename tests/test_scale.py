"""What keeps long texts cheap must not change what is found in them."""

from pyspark.sql import functions as F

from cautela.functions.regexes import NOT_AFTER_WORD, NOT_BEFORE_WORD, OTHER_CASES, SPACE, SPACE_CHARS, required_literals
from cautela.functions.text import squeeze
from cautela.operators.rules import TEXT_RULES, TextRule, may_match
from cautela.plans.assess import match_messages

SAID = (
    "final warning", "FINAL WARNİNG", "fınal warning", "within 5 minutes", "wıthin 7　hours", "Akaun anda akan dibekukan",
    "paKej anda ditahan", "bank in", "RM5.50", "rm 7", "pay", "payment", "one-time paſsword", "one time password", "police action", "POLİS",
    "you won", "you have won", "you never won", "claim your prize", "don't tell", "ſcreen sharing", "anydesk", "xanydesk", "anydesk_", "Tac", "attack",
    "", "nothing at all",
)


def plain_pattern(rule):
    body = "|".join(rule.alternatives).replace(r"\s", SPACE).replace(r"\d", r"\p{Nd}")
    return f"(?iu){NOT_AFTER_WORD}(?:{body}){NOT_BEFORE_WORD}"


def test_rules_find_what_their_plain_patterns_find(spark):
    texts = [t for s in SAID for t in (s, f"ok {s}!", f"é{s} {s}", f"{s}一 ({s})")] + [" ".join(SAID), None]
    rows = spark.createDataFrame([(t,) for t in texts], "normalised_text string").repartition(3)
    found = match_messages(rows.withColumnRenamed("normalised_text", "text")).drop("text")
    pairs = [(F.coalesce(f"_match_{i}", F.lit("")), F.regexp_extract("normalised_text", plain_pattern(r), 0)) for i, r in enumerate(TEXT_RULES)]
    counts = found.agg(*[F.count_if(a != b).alias(f"wrong_{i}") for i, (a, b) in enumerate(pairs)], *[F.count_if(b != "").alias(f"hit_{i}") for i, (_, b) in enumerate(pairs)])
    row = counts.first()
    assert [row[f"wrong_{i}"] for i in range(len(pairs))] == [0] * len(pairs)
    assert min(row[f"hit_{i}"] for i in range(len(pairs))) > 0


def test_patterns_run_only_where_their_plain_text_stands(spark):
    odd = (TextRule("any", "", "", 1, "", (r"\d+", "x")), TextRule("none", "", "", 1, "", ()))
    rows = spark.createDataFrame([("dear all",), ("Pay the ofııcer",), (None,)], "t string").coalesce(1)
    found = [r.m for r in rows.select(may_match(F.col("t"), (*TEXT_RULES, *odd)).alias("m")).collect()]
    rules = len(TEXT_RULES)
    assert found == [[False] * rules + [True, False], [r.code == "payment_request" for r in TEXT_RULES] + [True, False], [False] * rules + [True, False]]


def test_required_text_is_only_what_must_be_there():
    assert required_literals("you (?:have )?won") == ["you ", "won"]
    assert required_literals(r"ab{0}cd?e\.fg[hi]jk") == ["fg", "jk"]
    assert [required_literals(a) for a in ("ab|cd", r"ab\(|cd\)", "(?:ab|cd)", "a?")] == [[], [], [], []]
    assert required_literals("ab?c") == []


def test_letters_fold_to_ascii_from_the_listed_characters_only(spark):
    every = "".join(chr(i) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000)
    found = spark.createDataFrame([(every,)], "t string").select(F.regexp_extract_all("t", F.lit("(?iu)([a-z0-9])"), F.lit(1))).first()[0]
    assert sorted(found) == sorted("".join(OTHER_CASES.values()))


def test_squeeze_equals_split_and_join(spark):
    texts = ["a b c", " a  b ", "a\tb", "a \tb\t c", "　x　", "a  b  c", "\n", "", "é  \tf", *(f"a{c}b{c}{c}é{c}" for c in SPACE_CHARS), *(f"a{c}b{c}{c} c{c}" for c in SPACE_CHARS)]
    rows = spark.createDataFrame([(t, " ".join(t.split())) for t in texts], "t string, e string")
    assert rows.filter(squeeze(F.col("t")) != F.col("e")).count() == 0


def test_sample_documents_stand_in_one_folder(spark, tmp_path, monkeypatch):
    from workload import queries

    rows = [(c, t, ("user", "assistant", "system")[t], f"{c % 3} {t}") for c in range(40) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(queries, "_run_folder", lambda spark: f"{tmp_path}/run")
    found = {(r.risk_band, r.text_md5): r.rows for r in queries.QUERIES["sample_message_files"](spark, str(tmp_path)).collect()}
    assert found[("high_risk", "missing_text")] == 40 and sorted(found.values()) == [13, 13, 13, 13, 14, 14, 40]
    documents = list((tmp_path / "run" / "samples").rglob("*.txt"))
    assert len(documents) == 40 and {p.parent.name for p in documents} == {"samples"}
