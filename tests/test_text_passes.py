"""Text lines are parsed once, without sorting them for their headers."""

from quern.sources import files


def nodes(frame):
    plan, out = [frame._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        name = node.getClass().getSimpleName()
        out.append((name, node.simpleStringWithNodeId() if name == "ProjectExec" else node.simpleString(10_000)))
        plan += [node.inputPlan()] if name == "AdaptiveSparkPlanExec" else [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_no_line_is_parsed_twice(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('StockCode,Quantity,Price,InvoiceDate\na,1,2,2020-01-06\n\t b\t,2, 3,2020-01-07\n"c, d",1,1,2020-01-12\nx,1\n1,2,3,4,5\n,,NA,\n')
    rows = files.read_text(spark, str(path))
    parsed = "".join(text for _, text in nodes(rows.where("Quantity is not null and Price is not null")))
    assert parsed.count("from_csv(") == 1 and parsed.count("split(") == 1
    assert [tuple(r) for r in rows.collect()] == [("a", "1", "2", "2020-01-06"), ("b\t", "2", "3", "2020-01-07"), ("c, d", "1", "1", "2020-01-12"), ("x", "1", None, None), (None, None, None, None)]
    assert [r.line for r in files.malformed(spark, str(path)).collect()] == ["1,2,3,4,5"]
    weekly = files.weekly_series(rows, "StockCode", "Quantity", "Price", "InvoiceDate", [])
    assert not any("FileScan text" in text and name.startswith("FileSourceScan") for name, text in nodes(weekly))
    assert [(str(r.period), r.value) for r in weekly.collect()] == [("2020-01-06", 9.0)]
