from geoloom.llm import mixing

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, toxic, low=(), n=1000):
    text = lambda i: ("vile hateful rage " if i in toxic else "&&& *** ### " if i in low else "calm useful words ") * 12
    docs = spark.createDataFrame([(i, text(i)) for i in range(n)], "doc_id long, text string").repartition(4)
    return docs, spark.createDataFrame([(i, int(i not in low), int(i in toxic)) for i in range(n)], LABELS)


def test_scarce_domains_cost_no_clean_documents(spark):
    kept = {r["doc_id"] for r in mixing.mixed(*corpus(spark, {500})).select("doc_id").collect()}
    assert kept >= set(range(1000)) - {500}


def test_without_labels_all_documents_stay(spark):
    docs, _ = corpus(spark, {500})
    assert mixing.mixed(docs, spark.createDataFrame([], LABELS)).count() == 1000


def test_many_bad_documents_are_cut_to_their_shares(spark):
    toxic, low = set(range(0, 200)), set(range(200, 400))
    kept = {r["doc_id"] for r in mixing.mixed(*corpus(spark, toxic, low)).select("doc_id").collect()}
    assert kept >= set(range(400, 1000)) and len(kept & toxic) <= 15 and len(kept & low) <= 40
