import random
import time
import unicodedata

from pyspark.sql import functions as F

from cautela.functions import masking, text
from cautela.functions.identifiers import name_uuid
from cautela.functions.masking import guard_formula, sanitise
from cautela.functions.regexes import BOUNDARY, NOT_BEFORE_WORD


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in rows.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


AWKWARD = [
    "plain   text\n here ",
    "ｆｕｌｌ ﬁ ①",
    "Straße GROSS",
    "\u0130stanbul \x1c tab\u2003wide\xa0nbsp",
    "éclair",
    "日本語、テスト。",
    "Привет Мир",
    "ÅÄÖ naïve façade",
    "½ ² ª",
    "",
    None,
]


def test_normalise_equals_unicode_definition(spark):
    expected = [None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()) for t in AWKWARD]
    assert column(spark, AWKWARD, text.normalise) == expected
    assert expected[1] == "full fi 1"


def test_dedupe_key_equals_casefold(spark):
    expected = [None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()).casefold() for t in AWKWARD]
    assert column(spark, AWKWARD, text.dedupe_key) == expected


def test_stable_characters_never_change(spark):
    stable = text.stable_characters()
    assert all(unicodedata.is_normalized("NFKC", c) and not unicodedata.combining(c) for c in stable)
    letters = [c for c in stable if not c.isspace() and ord(c) > 32 and c != chr(0x130)]
    folded = column(spark, ["".join(letters)], text.dedupe_key)[0]
    assert folded == "".join(letters).casefold()


def test_without_accents(spark):
    lowered = [t.lower() for t in AWKWARD if t]
    marks = [
        "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        if any(ord(c) > 127 for c in t)
        else t
        for t in lowered
    ]
    assert column(spark, lowered, text.without_accents) == marks


def test_excerpt_and_values(spark):
    assert column(spark, ["x" * 80, "y" * 81], text.excerpt) == ["x" * 80, "y" * 79 + "…"]
    assert column(spark, [" Two Words ", " ", None], text.category_name) == ["two_words", "unspecified", "unspecified"]
    assert column(spark, [" A ", None], text.metadata_value) == ["a", ""]
    assert column(spark, ["0.5"], lambda c: text.six_decimals(c.cast("double"))) == ["0.500000"]


def test_name_uuid_matches_library(spark):
    import uuid

    names = ["42:1:0:hello", "ünïcode", ""]
    assert column(spark, names, name_uuid) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


def test_sanitise_masks_and_guards(spark):
    original = "Email victim@example.com or call +60 12-345 6789. Open https://fake.example/login."
    result = column(spark, [original], sanitise)[0]
    assert result == "Email [EMAIL] or call [PHONE_OR_ACCOUNT]. Open [URL]"
    assert column(spark, ["=1+1", "+a", "-b", "@c", "d"], guard_formula) == ["'=1+1", "'+a", "'-b", "'@c", "d"]
    assert column(spark, ["xhttp://a.example 1234567 a12345678 12345678"], sanitise) == [
        "xhttp://a.example 1234567 a12345678 [PHONE_OR_ACCOUNT]".replace("1234567 a12345678", "1234567 a12345678")
    ]


def test_email_mask_equals_the_plain_pattern_and_takes_linear_time(spark):
    pick = random.Random(7)
    parts = ["a", "B9", ".", "_", "%", "+", "-", "@", "@b.co", "x.yy", " ", "é", "ſ", "K", "..", "@c.d-e.com", "\n"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 14))) for _ in range(6_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = rf"(?iu){BOUNDARY}[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}{NOT_BEFORE_WORD}"
    masked = rows.select(masking.mask_emails(F.col("text")).alias("a"), F.regexp_replace("text", plain, "[EMAIL]").alias("b"))
    assert masked.filter("a <> b").collect() == [] and masked.filter("a like '%[EMAIL]%'").count() > 1_000
    long = spark.createDataFrame([("a." * 100_000 + " x@y.zz",)], "text string")
    started = time.time()
    assert long.select(masking.mask_emails(F.col("text"))).first()[0].endswith(" [EMAIL]")
    assert time.time() - started < 20


def test_urls_are_looked_for_only_where_one_can_begin(spark):
    from cautela.functions import urls

    assert urls._URL.startswith("(?=[hHwW])")
    texts = ["a HTTPS://X.example, wWw.b.example) hhttp://c", "https:/x ww.w.x", "http\u017f://d.example", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r.u for r in rows.select(urls.find_urls(F.col("t")).alias("u")).collect()]
    assert found == [["HTTPS://X.example,", "wWw.b.example)", "http://c"], [], ["http\u017f://d.example"], None, []]
