"""Every photo has a place, dated ones first."""

import datetime
import random

from docketlake.operators import records as R


def test_all_photos_in_order_of_date(spark):
    r = random.Random(3)
    rows = [(i, None if r.random() < 0.3 else datetime.datetime(2020, 1, 1) + datetime.timedelta(days=r.randint(0, 40))) for i in range(500)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "photo_id long, exif_date timestamp").repartition(7)
    want = {p: k + 1 for k, (p, _) in enumerate(sorted(rows, key=lambda x: (x[1] is None, x[1] or datetime.datetime.min, x[0])))}
    assert {x.photo_id: x.place for x in R.dated_first(df).collect()} == want
