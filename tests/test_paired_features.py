"""Features are computed for profiles that have a pair, not for all."""

from casewright.operators import correlation as C


def test_only_paired_profiles_have_features(spark, monkeypatch):
    p = C.profiles(spark.createDataFrame([(k, f"handle{k}") for k in range(20)], "profile_id long, username string"))
    pairs = spark.createDataFrame([(1, 2), (2, 5)], "a long, b long")
    seen, plain = [], C.features

    def counted(rows):
        seen.extend(r.profile_id for r in rows.select("profile_id").collect())
        return plain(rows)

    monkeypatch.setattr(C, "features", counted)
    got = C.score_pairs(p, pairs).select("a", "b").collect()
    assert sorted(tuple(r) for r in got) == [(1, 2), (2, 5)]
    assert sorted(seen) == [1, 2, 5]
