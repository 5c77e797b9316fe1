from leafmend.sources import ledger

GOOD = ("forms", "m", "p", 100, 110, 20, 0, 5, "2026-01-02", "a", "1", 1)


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    other = ("forms", "m", "p", 200, 210, 20, 0, 5, "2026-01-03", "b", "1", 1)
    ledger.append(spark.createDataFrame([GOOD, other, other, ("forms", None, "p", 1, 1, 1, 0, 0, "d", "c", "1", 1)], ledger.SCHEMA), path)
    (tmp_path / "ledger" / "broken.json").write_text('{"kind": "for\n')
    read = ledger.read(spark, path)
    assert read.count() == 3
    seed = spark.createDataFrame([GOOD], ledger.SCHEMA)
    labels = spark.createDataFrame([("b", "B")], "book string, label string")
    out = ledger.rows(seed, read, labels).collect()
    assert sorted(r.book for r in out) == ["B", "a"]
    assert ledger.rows(seed.where("false"), read.where("false")).count() == 0
