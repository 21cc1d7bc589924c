from graphloom.llm.near_dup import near_duplicates


def test_rows_that_share_an_id_are_linked_by_their_own_texts(spark):
    # Each id has two texts; each text has one near copy under another id.
    texts = [" ".join(f"t{k}w{j}" for j in range(200)) for k in range(12)]
    rows = [(k // 2, x) for k, x in enumerate(texts)] + [(100 + k, x + " end") for k, x in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id >= 100}
    assert got == {100 + k: k // 2 for k in range(12)}
