"""The small table of personally reviewed, fictional messages."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cautela.functions.identifiers import name_uuid
from cautela.sources.schemas import LABELLED_COLUMNS

SOURCE_NAME = "manual_messages"
CREATED_AT = datetime.date(2026, 7, 11)

# Fixed values: (label, text), all in Malay.
MESSAGES = (
    (
        1,
        "Tindakan segera: akaun bank anda akan dibekukan. Sahkan OTP sekarang di https://bank-check.example.",
    ),
    (
        1,
        "Pakej anda ditahan. Buat pemindahan RM5 sebagai yuran pelepasan melalui http://parcel-help.example.",
    ),
    (
        1,
        "Notis akhir LHDN: bayar RM300 sekarang atau tindakan undang-undang akan diambil. "
        "Semak di https://tax-payment.example.",
    ),
    (
        1,
        "Tahniah, anda diterima untuk kerja sambilan. Bayar deposit RM80 untuk aktifkan akaun "
        "sebelum tawaran tamat.",
    ),
    (
        1,
        "Waran tangkap telah dikeluarkan. Pindahkan wang RM500 sekarang untuk menghentikan tindakan polis.",
    ),
    (1, "Saya pegawai bank. Pasang AnyDesk dan kongsi skrin supaya akaun anda boleh disahkan."),
    (0, "Mesyuarat projek dipindahkan ke Bilik Seminar B2 pada pukul 2 petang esok."),
    (
        0,
        "Peringatan rasmi universiti: tarikh akhir urusan yuran pengajian ialah 25 Julai. "
        "Sila semak portal pelajar untuk maklumat lanjut.",
    ),
    (0, "Pakej anda sedia untuk diambil di kaunter. Sila semak aplikasi rasmi kurier untuk waktu operasi."),
    (
        0,
        "Peringatan keselamatan bank: jangan kongsi OTP, TAC, kata laluan, atau PIN dengan sesiapa.",
    ),
    (0, "Tolong beli susu dan roti semasa balik dari kampus petang ini."),
    (
        0,
        "Kelas tutorial petang ini dibatalkan. Pensyarah akan maklumkan tarikh kelas ganti melalui "
        "portal universiti.",
    ),
)


def curated_messages(spark: SparkSession, source_name: str = SOURCE_NAME) -> DataFrame:
    rows = spark.createDataFrame(
        [(i, label, text) for i, (label, text) in enumerate(MESSAGES)], "i int, label int, text string"
    )
    name = F.concat_ws(":", F.lit(source_name), F.col("i").cast("string"), F.col("label").cast("string"), "text")
    return rows.select(
        name_uuid(name).alias("record_id"),
        "text",
        "label",
        F.lit(source_name).alias("source"),
        F.lit("manually_curated_synthetic").alias("source_type"),
        F.lit("ms").alias("language"),
        F.lit("personally_reviewed").alias("review_status"),
        F.lit(True).alias("is_synthetic"),
        F.lit("Apache-2.0").alias("license"),
        F.lit(CREATED_AT).alias("created_at"),
    ).select(*LABELLED_COLUMNS)
