"""Audit and report operators on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from retailops.plans import audits as AU
from retailops.plans import reports as R


def test_code_table_flag_position(spark):
    ct = spark.createDataFrame([("F026", "AB1", " " * 25 + "Y"), ("F026", "CD2", " " * 25 + "N"),
                                ("F027", "EF3", " " * 25 + "Y")], "tbl_id string, tbl_elem_id string, tbl_elem_text string")
    assert [r.code for r in AU.code_table(ct, "F026", 26).collect()] == ["AB1"]
    assert [r.code for r in AU.code_table(ct, "F026", 26, id_len=2).collect()] == ["AB"]


def test_compare_flags_and_null_safety(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, None, 2), (3, "z", 3)], "k int, f string, g int")
    b = spark.createDataFrame([(1, "x", 1), (2, None, 5), (3, "Z", 3)], "k int, f string, g int")
    got = {r.k: (r.f_match, r.g_match) for r in AU.compare(a, b, ["k"], ["f", "g"]).collect()}
    assert got == {2: ("Y", "N"), 3: ("N", "Y")}


def test_reconcile_tags_missing_side(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted(tuple(r) for r in AU.reconcile(a, b, ["k"]).collect()) == [(1, "B"), (3, "A")]


def test_coverage_audit_classifies(spark):
    exp = spark.createDataFrame([(1, "n"), (2, "n"), (3, "n")], "item int, div string")
    act = spark.createDataFrame([(1, "n", "A"), (2, "n", "X"), (2, "n", "Y")], "item int, div string, st string")
    got = {r.item: r.problem for r in AU.coverage_audit(exp, act, ["item", "div"], "st", ["A"]).collect()}
    assert got == {2: "BAD STATUS", 3: "MISSING"}


def test_error_report_templates(spark):
    errs = spark.createDataFrame([("00320", "0000012300045"), ("00999", "0000000100002")], "err_cd string, meta string")
    rep = AU.error_report(errs, "meta", [("part", 1, 8, "long"), ("supp", 9, 5, "long")], "err_cd",
                          {"00320": "CASE {part} NOT ON FILE"}, default_template="OTHER {code}")
    assert sorted(r.message for r in rep.collect()) == ["CASE 123 NOT ON FILE", "OTHER 00999"]


def test_explode_sets_items_and_components(spark):
    items = spark.createDataFrame([(10,), (11,)], "sku int")
    comps = spark.createDataFrame([(10, 1, 2.0), (10, 2, 1.0), (10, 2, 1.0)], "set_sku int, comp int, qty double")
    cost = spark.createDataFrame([(1, 5.0), (2, 3.0)], "k int, c double")
    got = sorted(tuple(r) for r in R.explode_sets(items, comps, cost, "sku", "set_sku", "comp", "qty", "k", "c").collect())
    assert got == [(1, "COMP", 10, 2.0, 5.0), (2, "COMP", 10, 1.0, 3.0), (10, "SET", None, 1.0, 16.0),
                   (11, "ITEM", None, 1.0, None)]


def test_sectioned_report_skips_empty_sections(spark):
    s1 = spark.createDataFrame([("b",), ("a",)], "text string")
    s2 = spark.createDataFrame([], "text string")
    rows = sorted(tuple(r) for r in R.sectioned_report({"ONE": s1, "TWO": s2}).collect())
    assert rows == [(1, 0, "== ONE (2) =="), (1, 1, "a"), (1, 2, "b")]


def test_release_feed_unique_stamps(spark):
    a = spark.createDataFrame([(1, 5), (2, 6)], "k int, q int")
    b = spark.createDataFrame([(2, 6), (3, 7)], "k int, q int")
    out = R.release_feed(a, b, ["k", "q"], dt.datetime(2024, 1, 1), [("k", 3, "num"), ("q", 2, "num")])
    rows = sorted((r.k, r.record) for r in out.collect())
    assert rows == [(1, "00105" + "20240101000001"), (2, "00206" + "20240101000002"), (3, "00307" + "20240101000003")]


def test_version_in_force_ties_and_horizon(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), 1), (1, dt.date(2024, 2, 1), 1), (1, dt.date(2024, 2, 1), 2),
                                (1, dt.date(2024, 3, 1), 1)], "k int, f date, st int")
    got = sorted(tuple(r) for r in R.version_in_force(df, ["k"], "f", dt.date(2024, 2, 15), "st", [1, 2]).collect())
    assert got == [(1, dt.date(2024, 2, 1), 1), (1, dt.date(2024, 2, 1), 2)]


def test_in_stock_and_item_store_detail(spark):
    df = spark.createDataFrame([(1, "F", 5.0), (1, "O", 1.0), (2, "F", 3.0)], "s int, st string, q double")
    got = {r.s: r.pct_in_stock for r in R.in_stock(df, ["s"], F.col("st") == "F").collect()}
    assert got == {1: 50.0, 2: 100.0}
    base = spark.createDataFrame([(1,), (2,), (3,)], "s int")
    d = {r.s: (r.on_order, r.ever_f) for r in R.item_store_detail(
        base, df, ["s"], {"on_order": (F.col("st") == "O", F.col("q"))}, {"ever_f": F.col("st") == "F"}).collect()}
    assert d == {1: (1.0, "Y"), 2: (0.0, "Y"), 3: (0.0, "N")}


def test_price_list_codes_current_and_future(spark):
    iv = spark.createDataFrame([(1, dt.date(2024, 1, 1), dt.date(2024, 2, 1), 1.5), (1, dt.date(2024, 2, 1), dt.date(2024, 3, 1), 2.25),
                                (1, dt.date(2023, 1, 1), dt.date(2023, 2, 1), 9.0)], "k int, f date, t date, p double")
    got = sorted((r.price_code, r.price_digits) for r in R.price_list(iv, ["k"], "f", "t", "p", dt.date(2024, 1, 15), 5).collect())
    assert got == [("C", "00150"), ("F", "00225")]


def test_missing_changes_exclusions_and_inclusions(spark):
    model = spark.createDataFrame([(2, 10, "PROMO", "B1"), (2, 11, "PROMO", "B9"), (2, 12, "STD", "B9"), (2, 13, "STD", "B9")],
                                  "target int, item int, type string, brand string")
    target = spark.createDataFrame([(2, 13)], "target int, item int")
    miss = R.missing_changes(model, target, ["target", "item"], exclude=F.col("type") == "PROMO",
                             include=F.col("brand") == "B1")
    assert sorted(r.item for r in miss.collect()) == [10, 12]


def test_cost_list_latest_average_and_pending(spark):
    cur = spark.createDataFrame([(1, 5.0)], "k int, cost double")
    pnd = spark.createDataFrame([(1, 6.0), (2, 7.0)], "k int, cost double")
    hist = spark.createDataFrame([(1, 1, 4.0), (1, 3, 4.5), (1, 2, 9.0)], "k int, m int, avg double")
    got = sorted(tuple(r) for r in R.cost_list(cur, pnd, hist, ["k"], "m", "avg").collect())
    assert got == [(1, 5.0, 4.5, "CURRENT"), (1, 6.0, 0.0, "PENDING"), (2, 7.0, 0.0, "PENDING")]


def test_shelf_totals_and_site_classes(spark):
    pos = spark.createDataFrame([(1, 2, 3), (1, 1, 3), (2, 5, 1)], "item int, facings int, depth int")
    got = {r.item: (r.facings, r.capacity, r.min_fill) for r in
           R.shelf_totals(pos, ["item"], F.col("facings"), F.col("depth")).collect()}
    assert got == {1: (3, 9, 5), 2: (5, 5, 3)}
    hosts = spark.createDataFrame([("pos-store12",), ("web01",), ("db9",)], "h string")
    sites = [r.s for r in hosts.select(R.classify_hosts("h", [("pos-%", "STORE"), ("web%", "WEB")]).alias("s")).collect()]
    assert sites == ["STORE", "WEB", "OTHER"]


def test_fix_batch_high_water(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "rid int")
    batch, hw = R.fix_batch(q, "rid")
    assert hw == 3 and batch.count() == 3
    later = q.unionByName(spark.createDataFrame([(4,)], "rid int"))
    again, _ = R.fix_batch(later, "rid", high_water=hw)
    assert sorted(r.rid for r in again.collect()) == [1, 2, 3]


def test_in_stock_adjustments_lead_time_and_items(spark):
    from retailops.plans import reports as R
    df = spark.createDataFrame([("s", 1, "i1", True, 2.0), ("s", 1, "i2", False, 3.0), ("s", 2, "i1", True, 5.0)],
                               "src string, store int, item string, ok boolean, qty double")
    lead = spark.createDataFrame([("s", 3, 4)], "src string, a int, b int")
    rows = spark.createDataFrame([("s", 1, 7.0), ("s", 1, 1.0)], "src string, store int, qty double")
    for adj, want in (((F.col("qty") > 2, "qty"), {1: 3.0, 2: 5.0}), ((rows, "qty"), {1: 8.0, 2: 0.0})):
        out = R.in_stock(df, ["src", "store"], F.col("ok"), item_col="item", items_per=["src"], adjustments=adj,
                         lead=(lead, ["src"], ["a", "b"]), order=["src", "store"]).collect()
        assert [(r.store, r.n_total, r.n_items, r.lead_days, r.pct_in_stock) for r in out] == [(1, 2, 2, 7, 50.0), (2, 1, 2, 7, 100.0)]
        assert {r.store: r.adj_qty for r in out} == want


def test_a_price_below_zero_is_an_error(spark):
    import datetime as dt
    import pytest
    from retailops.plans.reports import price_list
    day = dt.date(2001, 1, 1)
    df = spark.createDataFrame([(1, day, dt.date(2002, 1, 1), -5.0)], "k int, f date, t date, p double")
    with pytest.raises(Exception, match="price below zero"):
        price_list(df, ["k"], "f", "t", "p", day).collect()
