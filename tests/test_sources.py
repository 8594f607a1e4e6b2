"""Readers on real files: names, headers, unreadable rows."""

import datetime as dt

import pytest

from barloom import schemas
from barloom.sources import files, sinks


def test_bar_files(spark, tmp_path):
    (tmp_path / "M&M.csv").write_text(
        "Date,Adj Close,Close,High,Low,Open,Volume\n2024-01-01,1,2,3,1,2,10\nnot a date,1,1,1,1,1,1\n2024-01-02,,,,,,\n"
    )
    (tmp_path / "NOLOW.csv").write_text("Date,Adj Close,Close,High,Low,Open,Volume\n2024-01-01,1,2,3,,2,10\n")
    rows = files.read_bars(spark, str(tmp_path)).collect()
    assert sorted((r.symbol, r.ts) for r in rows) == [("M&M", dt.date(2024, 1, 1)), ("NOLOW", dt.date(2024, 1, 1))]
    need = files.read_bars(spark, str(tmp_path), require=["open", "high", "low", "close"])
    assert [r.symbol for r in need.collect()] == ["M&M"]


def test_columns_by_name_and_whole_stems(spark, tmp_path):
    (tmp_path / "BRK.A.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2024-01-01,1,2,3,4,5,6\n")
    (tmp_path / "BRK.B.csv").write_text("\ufeffVolume,close,DATE\r\n7,8,2024-01-01\r\n")
    (tmp_path / "A B+C.csv").write_text('Date,"Close",Note\n2024-01-01,"9","x, y"\n2024-01-02,bad,\n')
    (tmp_path / "none.csv").write_text("1,2,3\n")
    got = {r.symbol: (r.open, r.high, r.low, r.close, r.adj_close, r.volume) for r in files.read_bars(spark, str(tmp_path)).collect()}
    assert got == {"BRK.A": (1, 2, 3, 4, 5, 6), "BRK.B": (None, None, None, 8, None, 7), "A B+C": (None, None, None, 9, None, None)}


def test_intraday_wall_clock(spark, tmp_path):
    (tmp_path / "A.csv").write_text("Datetime,Open,High,Low,Close,Volume\n2024-01-01 09:15:00+05:30,1,2,1,2,5\n")
    r = files.read_bars(spark, str(tmp_path), schemas.INTRADAY_FILE, intraday=True).first()
    assert r.ts == dt.datetime(2024, 1, 1, 9, 15)


def test_symbol_lists_and_snapshots(spark, tmp_path):
    lists, snaps = tmp_path / "u", tmp_path / "s"
    lists.mkdir(), snaps.mkdir()
    (lists / "small.csv").write_text("Symbol\nAAA\n BBB \n\nSymbol\n")
    got = files.read_symbol_sets(spark, str(lists)).collect()
    assert sorted((r.universe_id, r.symbol) for r in got) == [("small", "AAA"), ("small", "BBB")]
    (snaps / "2020-07-25.csv").write_text("Company Name,Industry,Symbol,Series,ISIN Code\nOld Co.,X,OLD,EQ,I1\n")
    canon = spark.createDataFrame([("OLD", "NEW")], "symbol string, canonical string")
    r = files.read_snapshots(spark, str(snaps), canon).first()
    assert (r.as_of, r.symbol, r.company) == (dt.date(2020, 7, 25), "NEW", "Old Co.")


def test_quoted_cells_and_lines(spark, tmp_path):
    (tmp_path / "2020-07-25.csv").write_text(
        'Company Name,Industry,Symbol,Series,ISIN Code\n"A ""B"" Ltd",X,AB,EQ,I1\n"Line\nBreak Co","x, y",LB,EQ,\n'
        'Symbol,SY,Symbol,EQ,I3\n"Company Name",Industry,Symbol,Series,"ISIN Code"\n,,,,\n"  ",Z, ZZ ,"",I4\n'
    )
    (tmp_path / "2021-01-01.csv").write_bytes("\ufeffISIN Code,symbol\r\nI9,\"C\"\"D\"\r\n".encode())
    (tmp_path / "2022-01-01.csv").write_text("")
    (tmp_path / "2023-01-01.csv").write_text("Name\nno such column\n")
    got = {(r.as_of.year, r.symbol): (r.company, r.industry, r.series, r.isin) for r in files.read_snapshots(spark, str(tmp_path)).collect()}
    assert got == {
        (2020, "AB"): ('A "B" Ltd', "X", "EQ", "I1"),
        (2020, "LB"): ("Line\nBreak Co", "x, y", "EQ", None),
        (2020, "Symbol"): ("Symbol", "SY", "EQ", "I3"),
        (2020, "ZZ"): (None, "Z", None, "I4"),
        (2021, 'C"D'): (None, None, None, "I9"),
    }


def test_files_are_scanned_once_and_only_asked_columns_leave_the_reader(spark, tmp_path):
    for k in range(40):
        lines = "".join(f"2024-01-{d:02d},{k},{d},x\n" for d in range(1, 29))
        (tmp_path / f"S{k}.csv").write_text(("Date,Open,Close,Note\n" if k % 2 else "Date,Close,Open,Note\n") + lines)
    bars = files.read_bars(spark, str(tmp_path), fields=["close"])
    text = bars._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert text.count("Scan csv") == 1 and "Exchange" not in text and "open" not in text.lower().split("scan csv")[0]
    rows = bars.collect()
    assert len(rows) == 40 * 28 and all(r.close == (r.ts.day if int(r.symbol[1:]) % 2 else int(r.symbol[1:])) for r in rows)
    wide = tmp_path / "wide"
    wide.mkdir()
    (wide / "W.csv").write_text(",".join(["Date", "Close", *[f"x{k}" for k in range(70)]]) + "\n")
    with pytest.raises(Exception, match="columns or more"):
        files.read_bars(spark, str(wide)).collect()


def test_event_dates(spark):
    raw = spark.createDataFrame(
        [("25-07-2020", "A", "Inclusion into Index"), ("2020-07-25 00:00:00", "B", "Exclusion"), ("?", "C", None)],
        "`Event Date` string, `Scrip Name` string, Description string",
    )
    got = {r.name: (r.date, r.action) for r in files.parse_index_events(raw).collect()}
    assert got == {"A": (dt.date(2020, 7, 25), "IN"), "B": (dt.date(2020, 7, 25), "OUT"), "C": (None, "OUT")}


def test_replace_keys_keeps_others(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_keys(spark.createDataFrame([("a", 1), ("b", 2)], "strategy_id string, v int"), path)
    sinks.replace_keys(spark.createDataFrame([("a", 7)], "strategy_id string, v int"), path)
    sinks.replace_keys(spark.createDataFrame([("a", 7)], "strategy_id string, v int"), path)
    assert sorted((r.strategy_id, r.v) for r in spark.read.parquet(path).collect()) == [("a", 7), ("b", 2)]


def test_emptied_keys_lose_their_rows(spark, tmp_path):
    path, ddl = str(tmp_path / "t"), "strategy_id string, v int"
    sinks.replace_keys(spark.createDataFrame([("a b", 1), ("c/d%e", 2), ("f=g", 3), ("h", 4)], ddl), path)
    keys = spark.createDataFrame([("a b",), ("c/d%e",), ("h",), ("never",)], "strategy_id string")
    sinks.replace_keys(spark.createDataFrame([("a b", 9)], ddl), path, keys=keys)
    assert sorted((r.strategy_id, r.v) for r in spark.read.parquet(path).collect()) == [("a b", 9), ("f=g", 3)]
    sinks.replace_keys(spark.createDataFrame([], ddl), str(tmp_path / "none"), keys=keys)


def test_large_files_are_read_in_pieces_like_small_ones(spark, tmp_path, monkeypatch):
    """Files whose lines are records are split; those with line breaks or stray quotes stay whole; rows are the same."""
    plain = "".join(f'"A ""{k}"", Ltd.",X, S{k} ,EQ,\r\n' for k in range(3000))
    head = "Company Name,Industry,Symbol,Series,ISIN Code"
    (tmp_path / "2020-01-01.csv").write_bytes(f"﻿{head}\r\n{plain}{head}\r\n\r\n,,,,\r\n".encode())
    (tmp_path / "2021-01-01.csv").write_text("\n\nseries,SYMBOL\n" + "".join(f'EQ,"T{k}",more\n' for k in range(3000)) + "series,SYMBOL,more\nseries,SYMBOL")
    (tmp_path / "2022-01-01.csv").write_text(head + "\n" + "".join(f'"Line\nBreak {k}",X,U{k},EQ,\n' for k in range(2000)))
    (tmp_path / "2023-01-01.csv").write_text(head + "\n" + "".join(f'a "b" {k},X,V{k},"E"Q,\n' for k in range(2000)))
    (tmp_path / "2024-01-01.csv").write_text("Name\n" + "no such column\n" * 3000)
    (tmp_path / "2025-01-01.csv").write_text("Symbol\nW\n")
    (tmp_path / "2026-01-01.csv").write_text("Symbol,Series\n" + "".join(f"Y{k},\n   \n" for k in range(2000)))
    rows = lambda: sorted(str(r) for r in files.read_snapshots(spark, str(tmp_path)).collect())
    monkeypatch.setattr(files, "WHOLE", 2**40)
    want = rows()
    assert len(want) == 3000 + 3001 + 2000 + 2000 + 1 + 2000
    monkeypatch.setattr(files, "WHOLE", 10_000)
    assert rows() == want
    found = files._plain_files(spark, str(tmp_path))
    assert {f.rsplit("/", 1)[1][:4] for f in found} == {"2020", "2021", "2024"}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert files.read_cells(spark, str(tmp_path / "2021-01-01.csv"), "Symbol", ["Symbol"]).rdd.getNumPartitions() > 2
        assert rows() == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
