"""Queries on small tables whose keys and texts are like those of larger ones, held against their SQL."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq

from corvane import catalog
from tests.oracle import rows_of_spark, rows_of_sql


def hold(spark, folder, name, **tables):
    """The query gives the rows of its SQL on the given tables."""
    import duckdb

    con = duckdb.connect()
    for table, rows in tables.items():
        pq.write_table(rows if isinstance(rows, pa.Table) else pa.table(rows), f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = rows_of_spark(catalog.queries()[name](spark, str(folder)))
    assert got[1] and got == rows_of_sql(con, catalog.oracle_sql()[name])


def test_first_and_last_by_keys_of_seven_digits(spark, tmp_path):
    # study, day, visit: the key outweighs the day from a million on
    visits = [(1, 1, 5_000_000), (1, 3, 20), (1, 4, 10), (2, 2, 7), (2, 2, 9), (3, None, 4), (3, 5, 3), (4, None, 1)]
    day = lambda d: None if d is None else datetime.datetime(1992, 1, 1) + datetime.timedelta(days=d)
    study, days, visit = zip(*visits)
    orders = {"o_orderkey": pa.array(visit, pa.int64()), "o_custkey": pa.array(study, pa.int64()), "o_orderstatus": ["P"] * len(visits), "o_totalprice": [1.0] * len(visits), "o_orderdate": pa.array([day(d) for d in days], pa.timestamp("us")), "o_orderpriority": ["1"] * len(visits)}
    hold(spark, tmp_path, "win7_first_and_last", orders=orders)


def test_paragraph_pieces_that_end_in_blanks(spark, tmp_path):
    word, tail = "x" * 299, "y" * 19
    ends = ["\n", "\t", "\r", "\v", "\f", " ", "\u00a0", "\u3000", "\u0085", "\u2028"]
    texts = [f"{word}z{e}{tail}" for e in ends] + [f"{e}{tail}\n{e}\n{word}{e}" for e in ends] + [None, "", " ", "short"]
    conversations = {"conv_id": pa.array(range(len(texts)), pa.int64()), "turn": pa.array([0] * len(texts), pa.int64()), "role": ["user"] * len(texts), "text": texts}
    hold(spark, tmp_path, "str16_str51_paragraphs", conversations=conversations)


def test_lists_of_a_dimension_beyond_one_broadcast(spark, monkeypatch):
    from corvane.operators import joins as J

    rows = spark.createDataFrame([(i, i % 5 if i % 7 else None) for i in range(60)], "header int, parent int")
    dim = spark.createDataFrame([(k % 4, k) for k in range(90)] + [(None, 1000), (3, 90), (3, 90), (2, None)], "parent int, sub int")
    want = sorted((r["header"], r["sub"] or -1) for r in rows.join(dim, "parent").collect())
    for small in (50, 50_000):
        monkeypatch.setattr(J, "SMALL_ROWS", small)
        found = J.listed(rows, dim, "parent", "sub", 8)
        assert sorted((r["header"], r["sub"] or -1) for r in found.collect()) == want
        assert found.columns == ["header", "parent", "sub"]


def test_headers_meet_suppliers_without_being_moved_again(spark, tmp_path, monkeypatch):
    """A dimension of more rows than may be broadcast still meets the headers as a few lists, so no join of few keys sorts or keeps them."""
    from corvane.operators import joins as J

    monkeypatch.setattr(J.broadcast_if_small, "__defaults__", (50,))
    n = 400
    lineitem = {"l_orderkey": pa.array([i % 90 for i in range(n)], pa.int64()), "l_suppkey": pa.array([i * 7 % 120 for i in range(n)], pa.int64()), "l_discount": [(i % 11) / 100 for i in range(n)]}
    supplier = {"s_suppkey": pa.array(range(120), pa.int64())}
    hold(spark, tmp_path, "gr15_subsection_scores", lineitem=lineitem, supplier=supplier)
    plan = catalog.queries()["gr15_subsection_scores"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan.split("collect_list")[0]


def shapes(n, m):
    part = {"p_partkey": pa.array([*range(n), 3], pa.int64()), "p_size": pa.array([*(i * 13 % 50 + 1 for i in range(n)), 9], pa.int32()), "p_retailprice": [900.0 + i * 37 % 700 for i in range(n + 1)]}
    return {"part": part, "supplier": {"s_suppkey": pa.array(range(m), pa.int64())}}


def pairs_tested(df):
    """Rows that joins of the plan gave, at most."""
    df.collect()
    plan, out = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            node = node.plan()
        if "Join" in node.nodeName():
            out = max(out, node.metrics().apply("numOutputRows").value())
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_shapes_of_one_place_meet_points_once(spark, tmp_path):
    tables = shapes(400, 4000)
    hold(spark, tmp_path, "jn16_nearest_shape", **tables)
    # 100 shapes lie on each page, at ten places
    assert pairs_tested(catalog.queries()["jn16_nearest_shape"](spark, str(tmp_path))) <= 400 * 10


def test_boxes_of_one_shape_meet_points_as_lists(spark, tmp_path):
    tables = shapes(400, 4000)
    hold(spark, tmp_path, "jn17_containment", **tables)
    df = catalog.queries()["jn17_containment"](spark, str(tmp_path))
    # a point meets shapes, not each of their boxes
    assert pairs_tested(df) < df.count()


def test_no_document_carries_a_sketch(spark, tmp_path):
    n = 500
    lineitem = {"l_orderkey": pa.array([i % 130 for i in range(n)], pa.int64()), "l_partkey": pa.array(range(n), pa.int64()), "l_suppkey": pa.array([i * 7 % 40 or None for i in range(n)], pa.int64()), "l_discount": [0.01] * n, "l_quantity": [1.0] * n, "l_returnflag": ["A"] * n, "l_linenumber": pa.array([1] * n, pa.int32())}
    hold(spark, tmp_path, "agg41_approximate_distinct", lineitem=lineitem)
    plan = catalog.queries()["agg41_approximate_distinct"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    sketched = [line for line in plan.split("\n") if "approx_count_distinct" in line]
    assert sketched and all("keys=[code" in line and "result_id" not in line.split("functions=")[0] for line in sketched)


def test_duplicate_answers_are_dealt_by_counted_rows(spark, monkeypatch):
    """A task groups a bounded number of rows, and an answer of many queries counts once."""
    from corvane.operators import analytics as A

    monkeypatch.setattr(A, "TASK_ROWS", 100)
    rows = spark.range(4000).selectExpr("id % 50 AS result_id", "CASE WHEN id % 3 = 0 THEN 'answer' WHEN id % 3 = 1 THEN concat('answer ', id) ELSE 'no' END AS content", "id % 7 AS query_id")
    found = A.duplicate_answers(rows)
    assert {(r["result_id"], r["duplicated"], r["queries"]) for r in found.collect()} == {(i, 1, 7) for i in range(50)}
    dealt = rows.where("length(content) > 5").count() // 100 + 1
    assert f", {dealt})" in found._jdf.queryExecution().executedPlan().toString().replace(", REPARTITION_BY_NUM", ")")


def test_headers_are_moved_once(spark, tmp_path):
    """Headers are grouped where they meet the suppliers: one exchange of line items, none of their headers."""
    n = 300
    lineitem = {"l_orderkey": pa.array([i % 70 if i < 200 else 7 for i in range(n)], pa.int64()), "l_suppkey": pa.array([i * 7 % 50 for i in range(n)], pa.int64()), "l_discount": [(i % 11) / 100 for i in range(n)]}
    hold(spark, tmp_path, "gr15_subsection_scores", lineitem=lineitem, supplier={"s_suppkey": pa.array(range(50), pa.int64())})
    plan = catalog.queries()["gr15_subsection_scores"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" not in plan and plan.split("BroadcastExchange")[0].count("Exchange ") == 1
