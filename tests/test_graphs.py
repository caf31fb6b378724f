from strandworks.operators import graphs


def test_neighbour_means_of_every_feature(spark):
    places = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 0)], "uid int, position int")
    z = {(0, 0): (1.0, 2.0), (0, 1): (3.0, 4.0), (0, 2): (5.0, 0.0), (1, 0): (7.0, 7.0)}
    values = spark.createDataFrame([(*k, f, x) for k, v in z.items() for f, x in enumerate(v)], "uid int, position int, feature int, z double")
    got = {(r.uid, r.position, r.feature): r.smoothed for r in graphs.neighbour_means(places, graphs.band_edges(places, 1), values, "z", ["feature"]).collect()}
    want = {(0, 0): (3.0, 4.0), (0, 1): (3.0, 1.0), (0, 2): (3.0, 4.0), (1, 0): (0.0, 0.0)}
    assert got == {(*k, f): x for k, v in want.items() for f, x in enumerate(v)}
