import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm.language_id import fit_languages


def test_the_driver_holds_one_language_at_a_time(spark):
    letters = np.array([list("abcdefgh"), list("ijklmnop"), list("qrstuvwx"), list("äöüßéèàç")])
    random = np.random.default_rng(5)
    rows = [(i, "abcd"[i % 4], "".join(random.choice(letters[i % 4], 400))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").cache()
    docs.count()
    tracemalloc.start()
    model = fit_languages(docs, F.lit(True))
    peak = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    assert model.languages == list("abcd")
    assert [model.predict(t)[0] for _, _, t in rows[:8]] == list("abcdabcd")
    # All texts' vectors at once are 39 MB, one language's 10 and as much again while it is clustered.
    assert peak < 35, peak
