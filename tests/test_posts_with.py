from strataloom.operators import enrich


def test_posts_with_bounded_sides(spark):
    posts = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, caption string")
    accounts = spark.createDataFrame([(5, "Ann", "ann")], "id long, display_name string, url_suffix string")
    rows = spark.createDataFrame([(1, i % 3 + 4, f"t{i}") for i in range(500)] + [(3, 5, "other"), (None, 5, "lost"), (2, None, None)], "post_id long, account_id long, text string")
    sides = {"comments": enrich.Side(rows, "account_id", ("text",), ("account_id", "text")), "likes": enrich.Side(rows.limit(0), "account_id", (), ("account_id",))}
    got = enrich.posts_with(posts, accounts, sides, most=2).collect()
    by_id = {r["id"]: r for r in got}
    assert len(got) == 3 and by_id[1]["n_comments"] == 500 and by_id[2]["n_comments"] == 1
    assert [(r["account_id"], r["account_display_name"], r["text"]) for r in by_id[1]["comments"]] == [(4, None, "t0"), (4, None, "t102")]
    assert [(r["account_id"], r["text"]) for r in by_id[2]["comments"]] == [(None, None)]
    assert all(r["n_likes"] == 0 and r["likes"] == [] for r in got)
    assert enrich.posts_with(posts.limit(0), accounts, sides).isEmpty()
