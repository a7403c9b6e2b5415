"""The categories of personal data, their order, priority and label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: wire id, priority in overlaps, label; in canonical order
TYPES = [
    ("FIO", 75, "[ФИО]"),
    ("BIRTH_DATE", 70, "[ДАТА РОЖДЕНИЯ]"),
    ("BIRTH_PLACE", 65, "[МЕСТО РОЖДЕНИЯ]"),
    ("PASSPORT", 90, "[ПАСПОРТ]"),
    ("PASSPORT_ISSUE_DATE", 70, "[ДАТА ВЫДАЧИ]"),
    ("PASSPORT_ISSUER", 65, "[КЕМ ВЫДАН]"),
    ("SUBDIVISION_CODE", 60, "[КОД ПОДРАЗДЕЛЕНИЯ]"),
    ("CITIZENSHIP", 55, "[ГРАЖДАНСТВО]"),
    ("DRIVER_LICENSE", 90, "[ВОДИТЕЛЬСКОЕ УДОСТОВЕРЕНИЕ]"),
    ("ADDRESS", 80, "[АДРЕС]"),
    ("COUNTRY", 50, "[СТРАНА]"),
    ("POSTAL_CODE", 50, "[ИНДЕКС]"),
    ("CITY", 50, "[ГОРОД]"),
    ("STREET", 50, "[УЛИЦА]"),
    ("HOUSE", 50, "[ДОМ]"),
    ("APARTMENT", 50, "[КВАРТИРА]"),
    ("EMAIL", 88, "[ПОЧТА]"),
    ("PHONE", 85, "[ТЕЛЕФОН]"),
    ("INN", 95, "[ИНН]"),
    ("CARD_NUMBER", 100, "[КАРТА]"),
    ("CARD_HOLDER", 75, "[ДЕРЖАТЕЛЬ КАРТЫ]"),
    ("CVV", 40, "[CVV]"),
    ("PIN", 40, "[ПИН]"),
    ("SNILS", 95, "[СНИЛС]"),
    ("FOREIGN_PASSPORT", 90, "[ЗАГРАНПАСПОРТ]"),
    ("BIRTH_CERTIFICATE", 60, "[СВИДЕТЕЛЬСТВО О РОЖДЕНИИ]"),
    ("MILITARY_ID", 60, "[ВОЕННЫЙ БИЛЕТ]"),
    ("RESIDENCE_PERMIT", 60, "[ВИД НА ЖИТЕЛЬСТВО]"),
    ("OMS_POLICY", 90, "[ПОЛИС ОМС]"),
    ("BANK_ACCOUNT", 100, "[СЧЁТ]"),
]

NAMES = [t[0] for t in TYPES]
PRIORITY = {t[0]: t[1] for t in TYPES}
LABEL = {t[0]: t[2] for t in TYPES}
CUSTOM_PRIORITY = 10
FALLBACK_LABEL = "[ПД]"

SPAN = "struct<start:int,end:int,type:string,conf:double,src:string,hint:string>"
SPANS = f"array<{SPAN}>"


def dimension(spark: SparkSession) -> DataFrame:
    """(type, ord, priority, label): one row per category."""
    rows = [(name, i, priority, label) for i, (name, priority, label) in enumerate(TYPES)]
    return spark.createDataFrame(rows, "type string, ord int, priority int, label string")
