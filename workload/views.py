"""Input views of the registered queries, over whole tables and whole texts.

The generated tables hold invented prose in which no warning rule matches. So each text is preceded
by a fixed message picked by the row's number; the oracle SQL builds the same view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cautela.sources.tables import read_texts

# (suspicious?, message); {n} becomes a number of the row.
OPENERS = (
    (1, "URGENT: Your email account will be suspended. Verify now at http://verify-account.example."),
    (0, "Hi Aina, our class starts at 9 AM in the engineering lab."),
    (1, "Parcel anda ditahan. Bayar yuran RM{n} segera melalui http://parcel-fee.example/{n}!"),
    (1, "Saya pegawai bank. Berikan OTP anda sekarang untuk pengesahan."),
    (0, "Mesyuarat kumpulan kita esok pukul 2 PM di perpustakaan."),
    (1, "Final warning: transfer RM{n} today or legal action will be taken."),
    (1, "Tindakan segera: akaun anda akan dibekukan. Do not tell anyone, reply within {n} minutes."),
    (0, "Reminder: submit the assignment before 4:15 PM through the university portal (www.portal.example/{n})."),
    (1, "Customer service here. Install screen sharing software so we can secure your bank account."),
    (1, "You have won a free gift. Click https://reward-centre.example and HTTPS://REWARD-CENTRE.example tonight."),
    (1, "Login at http://192.0.2.{n}/login and enter your verification code."),
    (1, "Visit https://user@xn--exampl-gva.com:8443/a?b={n} to keep your parcel."),
    (1, "Claim your prize: http://bit.ly/{n}, or https://deals{n}.xyz, then https://deals{n}.xyz again."),
    (0, "The workshop venue changed, see www.seminar-room-{n}.click for the map."),
    (0, "Forwarded: www.a.com/?u=http://b.example/{n} ok?"),
    (0, "Saya dah sampai kampus. Jumpa dekat kafeteria ya."),
    (1, "Police notice {n}: install AnyDesk immediately, this is a confidential transaction."),
    (0, "Can you send me the slides from today's lecture when you are free?"),
    (1, "Waran tangkap! Pindahkan wang RM{n}.50 sekarang juga."),
)


TEXT_TABLES = ("benchmark", "conversations", "documents", "orders", "pages")
#: Tasks over which the bench deals the text tables, each of which is one row group in its small input; None elsewhere.
SPREAD: int | None = None


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    return read_texts(spark, path, SPREAD) if table in TEXT_TABLES else spark.read.parquet(path)


def opener(number: Column) -> Column:
    texts = F.array(*[F.lit(t) for _, t in OPENERS])
    picked = F.element_at(texts, (number % len(OPENERS) + 1).cast("int"))
    return F.replace(picked, F.lit("{n}"), (number % 250).cast("string"))


def opener_label(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s, _ in OPENERS]), (number % len(OPENERS) + 1).cast("int"))


def message_rows(df: DataFrame, message_id: Column, number: Column, text: Column, *more: Column) -> DataFrame:
    return df.select(
        message_id.alias("message_id"),
        F.concat(opener(number), F.lit(" "), text).alias("text"),
        opener_label(number).alias("label"),
        *more,
    )


def document_messages(documents: DataFrame) -> DataFrame:
    return message_rows(
        documents, F.concat(F.lit("D"), F.col("doc_id").cast("string")), F.col("doc_id"), F.col("text")
    )


def order_messages(orders: DataFrame, *more: Column) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.concat(F.lit("Ref "), key.cast("string"), F.lit(" "), F.col("o_orderpriority"))
    return message_rows(orders, F.concat(F.lit("O"), key.cast("string")), key, text, *more)


def conversation_messages(conversations: DataFrame) -> DataFrame:
    ids = F.concat(F.lit("C"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return message_rows(conversations, ids, F.col("conv_id") + F.col("turn"), F.col("text"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(message_id, text, label) of every document, conversation turn and order."""
    return (
        document_messages(read(spark, sf_dir, "documents"))
        .unionByName(conversation_messages(read(spark, sf_dir, "conversations")))
        .unionByName(order_messages(read(spark, sf_dir, "orders")))
    )


def labelled_sources(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    """Document texts with their quality label and again with their toxicity label, in labelled form.

    The two labels often differ, so the same text arrives with both classes.
    """
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    both = documents.join(labels, "doc_id")

    def source(kind: str) -> DataFrame:
        return both.select(
            F.concat(F.lit(f"{kind}-"), F.col("doc_id").cast("string")).alias("record_id"),
            "text",
            F.col(kind).alias("label"),
            F.col("source"),
            F.lit(kind).alias("source_type"),
            F.col("lang").alias("language"),
            F.lit("unreviewed").alias("review_status"),
            F.lit(False).alias("is_synthetic"),
            F.lit("unknown").alias("license"),
            F.lit("2026-07-10").cast("date").alias("created_at"),
        )

    return [("quality", source("quality")), ("toxic", source("toxic"))]


def _choice(number: Column, divisor: int, values) -> Column:
    index = (F.floor(number / divisor) % len(values) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)


# Property values given to customers in turn, so that every branch of the trust policy occurs.
PROPERTY_VALUES = {
    "source_classification": (
        1,
        ("official", "official_style_guidance", "synthetic", "public", "demonstration", "community", "mystery", "", " Official "),
    ),
    "review_status": (3, ("reviewed", "Reviewed ", "reviewed", "unverified")),
    "freshness_status": (5, ("current", "", "current", "stale")),
    "reliability_level": (1, ("high", "medium", "low", "")),
    "allowed_for_decision": (7, ("true", "yes", "false", "supporting_only", "true", "NO", "")),
    "evidence_role": (2, ("primary", "pattern_support", "")),
}


def evidence_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as an evidence source."""
    key = F.col("c_custkey")
    pairs = [
        x for name, (divisor, values) in PROPERTY_VALUES.items() for x in (F.lit(name), _choice(key, divisor, values))
    ]
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("urn:source:"), key.cast("string")).alias("urn"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("description"),
        F.create_map(*pairs).alias("custom_properties"),
        F.col("c_nationkey").alias("nation_key"),
    )


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports: every document and every order as a message with a category and a time."""
    doc, order = F.col("doc_id"), F.col("o_orderkey")
    from_documents = read(spark, sf_dir, "documents").select(
        F.concat(F.lit("D"), doc.cast("string")).alias("message_id"),
        F.concat(opener(doc), F.lit(" "), F.col("text")).alias("text"),
        F.concat(F.lit(" Lang "), F.col("lang"), F.lit(" ")).alias("category"),
        F.timestamp_seconds(F.lit(1_704_067_200) + 60 * doc).alias("submitted_at"),
    )
    from_orders = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("O"), order.cast("string")).alias("message_id"),
        F.concat(opener(order), F.lit(" call +60 12-"), (order + 1_000_000).cast("string"), F.lit(" or a@b.example")).alias("text"),
        F.col("o_orderpriority").alias("category"),
        F.timestamp_seconds(F.lit(1_704_067_200) + order).alias("submitted_at"),
    )
    return from_documents.unionByName(from_orders)
