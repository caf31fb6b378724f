"""Every reader and writer on files written here."""

import gzip
import json

import pytest

from strandworks.sources import readers as R


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">d1abc_ a.1.2.3 some words\nACDE\nfgh\n>d2xyz_\nKLM\n\n>d3_ b.7\nN\n")
    got = [(r.uid, r.sccs, r.fold, r.sequence) for r in R.read_fasta(spark, str(tmp_path)).orderBy("file_ordinal").collect()]
    assert got == [("d1abc_", "a.1.2.3", "a.1", "ACDEFGH"), ("d2xyz_", None, "unknown", "KLM"), ("d3_", "b.7", "b.7", "N")]


def _atom(n, name, res, chain, k, x, kind="ATOM"):
    return f"{kind:<6}{n:>5} {name:<4} {res} {chain}{k:>4}    {x:8.3f}{0:8.3f}{-1.5:8.3f}"


def test_structures(spark, tmp_path):
    rows = [_atom(1, " CA", "ALA", "A", 1, 1.0)]
    rows += [_atom(i, " CA", res, "B", i, i) for i, res in enumerate(("SEC", "PYL", "ASX", "GLX", "QQQ", "gly"), 2)]
    rows += [_atom(20, " CB", "ALA", "B", 9, 1.0), _atom(21, " CA", "ALA", "B", 9, 1.0, "HETATM"), "ENDMDL", _atom(30, " CA", "ALA", "B", 10, 1.0)]
    (tmp_path / "x.pdb").write_text("\n".join(rows))
    got = R.read_structures(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert "".join(r.letter for r in got) == "UOBZXG" and {r.chain for r in got} == {"B"} and [r.ordinal for r in got] == list(range(6))
    assert got[0].x == 2.0 and got[0].z == -1.5


@pytest.mark.parametrize("data", [{"a": "AC", "b": "D"}, [{"uid": "a", "sequence": "AC"}, {"name": "b", "seq": "D"}, {"id": "c"}], [["a", "AC"], ["b", "D"]], ["AC", "D"]])
def test_sequences(spark, tmp_path, data):
    (tmp_path / "s.json").write_text(" " + json.dumps(data))
    got = sorted(tuple(r) for r in R.read_sequences(spark, str(tmp_path), ["a", "b"]).collect())
    assert got == [("a", "AC"), ("b", "D")]


def test_sequences_of_several_layouts_and_lengths(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"z": "AC"}))
    (tmp_path / "t.json").write_text(json.dumps([["b", "D"]]))
    assert [tuple(r) for r in R.read_dataset(spark, str(tmp_path)).collect()] == [("b", "D"), ("z", "AC")]
    (tmp_path / "u.json").write_text(json.dumps(["A", "C"]))
    with pytest.raises(Exception, match="as many uids"):
        R.read_sequences(spark, str(tmp_path / "u.json"), ["a"]).collect()


def test_residues(spark, tmp_path):
    (tmp_path / "r.csv").write_text("uid,position_pdb,ss_8class,sasa,neighbor_count\na,1,H,0.5,3\na,2,-,,4\n")
    got = [tuple(r) for r in R.read_residues(spark, str(tmp_path)).orderBy("position").collect()]
    assert got == [("a", 0, "H", 0.5, 3), ("a", 1, None, None, 4)]


def test_annotations_and_features(spark, tmp_path):
    with gzip.open(tmp_path / "m.csv.gz", "wt") as f:
        f.write("# made here\nPDB,ACC\n1abc,P1\n2xyz,P2\n3def,P3\n")
    wanted = spark.createDataFrame([("1abc",), ("3def",), ("3def",)], "PDB string")
    assert sorted(r.ACC for r in R.read_annotations(spark, str(tmp_path / "m.csv.gz"), wanted, "PDB").collect()) == ["P1", "P3"]
    assert [r.ACC for r in R.read_annotations(spark, str(tmp_path / "m.csv.gz"), wanted, "PDB", 1).collect()] == ["P1"]
    (tmp_path / "f.json").write_text(json.dumps({"accession": "P1", "features": [{"type": "site", "begin": 3, "end": 4}, {"type": "bind", "begin": "x"}]}))
    got = sorted(tuple(r) for r in R.read_features(spark, str(tmp_path / "f.json")).collect())
    assert got == [("P1", "bind", None, None, None), ("P1", "site", 3, 4, None)]


def test_layers(spark, tmp_path):
    lengths = spark.createDataFrame([("a", 2), ("b", 1)], "uid string, length int")
    acts = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "uid string, position int")
    assert R.snapshot(acts, str(tmp_path / "acts")) and not R.snapshot(acts.limit(1), str(tmp_path / "acts"))
    assert R.read_layer(spark, str(tmp_path / "acts"), lengths).count() == 3
    assert R.check_counts(acts.where("position = 0"), lengths).collect()[0][:] == ("a", 2, 1)
    with pytest.raises(ValueError, match="chain c"):
        R.read_layer(spark, str(tmp_path / "acts"), lengths.unionByName(spark.createDataFrame([("c", 4)], "uid string, length int")))
    for model, layer, names in (("m", 0, "xy"), ("m", 12, "xy"), ("m", 3, "x"), ("n", 1, "xy")):
        folder = tmp_path / "out" / model / f"layer_{layer}"
        folder.mkdir(parents=True)
        for n in names:
            (folder / f"{n}.csv").write_text("feature,v\n1,2.5\n")
    assert {r.model: r.layers for r in R.complete_layers(spark, str(tmp_path / "out"), ("x.csv", "y.csv")).collect()} == {"m": [0, 12], "n": [1]}
    tables = R.read_results(spark, str(tmp_path / "out/m/layer_0"), "m_layer_0", ("x", "y"))
    assert [tuple(r) for r in tables["y"].collect()] == [(1, 2.5, "m_layer_0")]


def test_sinks(spark, tmp_path):
    entries = spark.createDataFrame([("a", "f", "ACD"), ("b", "g", "A")], "uid string, fold string, sequence string")
    R.write_dataset(entries, entries.select("uid"), str(tmp_path / "d"))
    got = spark.read.json(str(tmp_path / "d/summary")).first()
    assert (got.n, got.folds, got.total, got.median_length) == (2, 2, 4, 2.0)
    with pytest.raises(Exception, match="already exists"):
        R.write_dataset(entries, entries.select("uid"), str(tmp_path / "d"))
    cells = spark.createDataFrame([("m", 1, 0.5)], "model string, layer int, v double")
    R.write_cells(cells, str(tmp_path / "c"))
    assert R.layers(spark.read.parquet(str(tmp_path / "c"))).first().layers == [1]


def test_headers_without_sequences(spark, tmp_path):
    (tmp_path / "s.fa").write_text(">d1 a.1.2.3 first one\nACD\nEF\r\n>d2\r\nGH\n>d3 b.2\n")
    whole = R.read_fasta(spark, str(tmp_path / "s.fa"))
    assert [(r.uid, r.sccs, r.fold, r.sequence) for r in whole.orderBy("file_ordinal").collect()] == [("d1", "a.1.2.3", "a.1", "ACDEF"), ("d2", None, "unknown", "GH"), ("d3", "b.2", "b.2", "")]
    heads = R.read_headers(spark, str(tmp_path / "s.fa"))
    assert sorted(tuple(r) for r in heads.collect()) == sorted(tuple(r) for r in whole.select("uid", "sccs", "fold").collect())
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert "upper(" not in plan and "regexp_replace" not in plan and "regexp_extract" in plan


def test_shuffled_rows_read_a_bounded_part(spark, tmp_path):
    spark.range(0, 200_000, 1, 4).selectExpr("id", "repeat(uuid(), 20) AS x").write.parquet(str(tmp_path / "t"))
    seen = spark.sparkContext.accumulator(0)

    def counted(it):
        for batch in it:
            seen.add(batch.num_rows)
            yield batch

    table = spark.read.parquet(str(tmp_path / "t"))
    some = [r.id for r in R.shuffled_rows(table.mapInArrow(counted, table.schema), 400, 7, 1000).collect()]
    assert len(set(some)) == 400 and seen.value < 100_000, seen.value
    assert some == [r.id for r in R.shuffled_rows(table, 400, 7, 1000).collect()]
    assert some != [r.id for r in R.shuffled_rows(table, 400, 8, 1000).collect()] and some != sorted(some)
    uneven = spark.createDataFrame([(i,) for i in range(50)], "id long").repartition(1).unionByName(spark.createDataFrame([(99,)], "id long").repartition(3))
    assert len({r.id for r in R.shuffled_rows(uneven, 40, 1, 8).collect()}) == 40
    assert {r.id for r in R.shuffled_rows(uneven, 1000, 1, 8).collect()} == {*range(50), 99} and R.shuffled_rows(uneven.limit(0), 5, 1).count() == 0
