from cardloom.llm import decontaminate


def found(spark, items, texts):
    items = spark.createDataFrame(list(enumerate(items, 1)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    return sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect())


def test_items_that_share_windows(spark):
    three, four = (f"Ann has 3 apples and Bob has {n} pears in the basket today" for n in (3, 4))
    assert found(spark, [three, four, four], [four, three]) == [(1, 2), (1, 3), (2, 1)]


def test_a_clash_leaves_verbatim_windows_found(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    words[5] = words[50] = "17"
    words[20] = "23"
    changed = [*words[:50], "18", *words[51:]]
    other = [*words[:40], *["18" if w == "17" else w for w in words[40:]]]
    assert found(spark, [" ".join(words)], [" ".join(changed), " ".join(other), " ".join(words[:7])]) == [(1, 1), (2, 1)]


def test_windows_of_placeholders_and_first_words(spark):
    sums = "12 34 56 78 90 11 22 33 44 55 km 66"
    france, river = "What is the capital of France?", "the Paris river flows through many green towns here"
    texts = [f"so {sums} end", "so 12 34 56 78 90 11 22 34 44 55 km 67 end", f"Q: {france} yes", "Q: Where is the capital of France?", "Paris river flows through many green towns here today", "London river flows through many green towns here"]
    assert found(spark, [sums, france, river], texts) == [(1, 1), (3, 2), (5, 3)]
