"""Event dates as an expression equal the plain rules, on phrases that compete and dates that don't exist."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from daybook.functions import dates

PHRASES = ["ngày {d} tháng {m}", "Ngày {d}  tháng {m} năm {y}", "{d}/{m}/{y}", "{d}-{m}-{y}", "hôm {d}/{m}", "ngày {d}/{m}", "hôm {d}/{m}/{y}", "ngày {d}/{m} - 3", "hôm qua", "HÔM KIA", "hôm quay", "thứ {w} tuần trước", "thứ 8 vừa rồi", "chủ nhật vừa rồi", "thứ {w} vừa  rồi",
           "cuối tuần", "cuối tuần trước", "tuần trước", "tháng trước", "x{d}/{m}/{y}", "{d}/{m}/{y}0", "_hôm qua", "không có gì", "29/2/{y}", "31/{m}/{y}", "ngày 31 tháng {m}", "hôm 29/2", "00/{m}/{y}", "{d}/13/{y}", "1/1/0000"]


def test_expression_equals_the_plain_rules(spark):
    draw = random.Random(12)
    rows = [("", date(2024, 1, 1)), ("a", date(2024, 3, 31))]
    for _ in range(1500):
        told = " ".join(draw.choice(PHRASES).format(d=draw.randrange(1, 32), m=draw.randrange(1, 13), y=draw.randrange(1999, 2026), w=draw.randrange(2, 8)) for _ in range(draw.randrange(1, 4)))
        rows.append((told, date(2023, 1, 1) + timedelta(days=draw.randrange(900))))
    df = spark.createDataFrame([(*r,) for r in rows], "text string, today date")
    got = df.select("text", "today", dates.event_date(F.col("text"), F.col("today")).alias("e")).collect()
    assert len(got) == len(rows) and sum(r.e is not None for r in got) > 800
    for r in got:
        want = dates.infer_event_date(r.text, r.today)
        assert (r.e and tuple(r.e)) == want, (r.text, r.today)
    assert df.select(dates.event_date(F.lit(None).cast("string"), F.col("today")).alias("e")).first().e is None
