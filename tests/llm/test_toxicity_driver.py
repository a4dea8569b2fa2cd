"""The toxicity model is fitted in a task: the driver gets its weights, not the words of the labelled texts."""

import numpy as np

from skerry.llm import toxicity


def sent(spark) -> int:
    """Bytes that tasks have sent to the driver so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).resultSize() for k in range(stages.size()))


def test_texts_of_the_fit_stay_with_the_tasks(spark):
    rows = []
    for k in range(1500):
        own = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(150))
        rows.append((k, f"common {own} awful" if k % 5 == 0 else f"common {own}", int(k % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(8).cache()
    docs, labels = df.drop("toxic"), df.drop("text")
    df.count()
    before = sent(spark)
    model = toxicity.fit(docs, labels, held_out=None)
    assert sent(spark) - before < 300_000  # the texts are 1.8 MB
    by = sorted((" ".join(sorted(toxicity.words_of(t))), y) for _, t, y in rows)
    assert model == toxicity.fit_words([set(w.split()) for w, _ in by], np.array([float(y) for _, y in by]))
    assert model.weights["awful"] > 0
    df.unpersist()
