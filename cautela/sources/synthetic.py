"""Labelled messages expanded from templates.

Each row is a function of (seed, label, index): slot values are picked by hash, so any range of
indexes can be generated by any task and gives the same rows.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cautela.functions.identifiers import hash_pick, name_uuid
from cautela.sources.schemas import LABELLED_COLUMNS

SOURCE_NAME = "synthetic_messages"
CREATED_AT = datetime.date(2026, 7, 10)
MIN_ROWS_PER_CLASS = 20

# Fixed values: (language, template) per class, and the values of each slot.
SUSPICIOUS_TEMPLATES = (
    ("en", "URGENT: Your {service} account will be suspended. Verify now at {url}."),
    ("ms", "Parcel anda ditahan. Bayar yuran RM{fee} segera melalui {url}."),
    ("mixed", "Tahniah! Anda menang hadiah RM{amount}. Bayar processing fee RM{fee} untuk claim."),
    ("ms", "Saya pegawai {organisation}. Berikan OTP anda sekarang untuk pengesahan."),
    ("en", "Final warning: transfer RM{amount} today or legal action will be taken."),
    ("ms", "Kerja sambilan mudah dari rumah. Deposit RM{fee} dahulu untuk aktifkan akaun."),
    ("en", "Your refund is ready. Login using {url} and enter your verification code."),
    ("mixed", "Jangan beritahu sesiapa. This confidential transaction must be completed now."),
    ("en", "Customer service here. Install {remote_app} so we can secure your bank account."),
    ("en", "You have won a free gift. Click {url} before the offer expires tonight."),
)
LEGITIMATE_TEMPLATES = (
    ("en", "Hi {name}, our class starts at {time} in the engineering lab."),
    ("ms", "Mesyuarat kumpulan kita esok pukul {time} di perpustakaan."),
    ("en", "Your order is ready for pickup. Please check the official app for details."),
    ("en", "Reminder: submit the assignment before {time} through the university portal."),
    ("ms", "Saya dah sampai kampus. Jumpa dekat kafeteria ya."),
    ("en", "The workshop venue changed to Seminar Room {room}."),
    ("en", "Mom asked whether you will be home for dinner at {time}."),
    ("ms", "Bil anda sudah tersedia. Semak jumlah dalam aplikasi rasmi syarikat."),
    ("en", "Your appointment is confirmed for {time}. Reply if you need to reschedule."),
    ("en", "Can you send me the slides from today's lecture when you are free?"),
)
SLOTS = {
    "service": ("email", "shopping", "cloud", "delivery"),
    "organisation": ("bank", "courier company", "tax office", "support centre"),
    "name": ("Aina", "Daniel", "Mei", "Ravi", "Sara", "Veron"),
    "time": ("9 AM", "11:30 AM", "2 PM", "4:15 PM", "7 PM"),
    "room": ("A", "B2", "3", "5C"),
    "amount": ("50", "100", "500", "2000"),
    "fee": ("2", "5", "20", "50"),
    "remote_app": ("a remote support app", "screen sharing software", "remote desktop software"),
    "url": (
        "http://verify-account.example",
        "http://parcel-fee.example",
        "https://reward-centre.example",
        "https://secure-login.example",
    ),
}


def _lookup(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def expand_templates(rows: DataFrame, index: str, label: str, seed: int = 42) -> DataFrame:
    """One labelled record per input row; ``index`` counts within ``label`` (1 suspicious, 0 not)."""
    i, is_suspicious = F.col(index).cast("bigint"), F.col(label) == 1

    def pick(slot: str, size: int) -> Column:
        return hash_pick([F.lit(str(seed)), F.col(label).cast("string"), i.cast("string"), F.lit(slot)], size)

    template = F.when(is_suspicious, _lookup([t for _, t in SUSPICIOUS_TEMPLATES], i % 10)).otherwise(
        _lookup([t for _, t in LEGITIMATE_TEMPLATES], i % 10)
    )
    language = F.when(is_suspicious, _lookup([x for x, _ in SUSPICIOUS_TEMPLATES], i % 10)).otherwise(
        _lookup([x for x, _ in LEGITIMATE_TEMPLATES], i % 10)
    )
    filled = template
    for slot, values in SLOTS.items():
        filled = F.replace(filled, F.lit("{" + slot + "}"), _lookup(values, pick(slot, len(values))))
    reference = (pick("reference", 9000) + 1000).cast("string")
    base = rows.select(*rows.columns, filled.alias("_filled"), language.alias("language"))
    text = (
        F.when(i % 3 == 0, F.concat(F.col("_filled"), F.lit(" Ref "), reference))
        .when(i % 3 == 1, F.replace("_filled", F.lit("."), F.lit("!")))
        .otherwise(F.col("_filled"))
    )
    name = F.concat_ws(":", F.lit(str(seed)), F.col(label).cast("string"), i.cast("string"), F.col("text"))
    return (
        base.withColumn("text", text)
        .select(
            name_uuid(name).alias("record_id"),
            "text",
            F.col(label).cast("int").alias("label"),
            F.lit(SOURCE_NAME).alias("source"),
            F.lit("synthetic").alias("source_type"),
            "language",
            F.lit("template_reviewed").alias("review_status"),
            F.lit(True).alias("is_synthetic"),
            F.lit("Apache-2.0").alias("license"),
            F.lit(CREATED_AT).alias("created_at"),
        )
        .select(*LABELLED_COLUMNS)
    )


def synthetic_messages(spark: SparkSession, rows_per_class: int = 600, seed: int = 42) -> DataFrame:
    if rows_per_class < MIN_ROWS_PER_CLASS:
        raise ValueError(f"rows_per_class must be at least {MIN_ROWS_PER_CLASS}.")
    rows = spark.range(2 * rows_per_class).select(
        (F.col("id") % rows_per_class).alias("i"),
        F.when(F.col("id") < rows_per_class, F.lit(1)).otherwise(F.lit(0)).alias("label"),
    )
    return expand_templates(rows, "i", "label", seed)
