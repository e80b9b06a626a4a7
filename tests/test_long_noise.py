"""Comments and literals of any length, against a plain scan."""

import random

from pyspark.sql import functions as F

from skylark.functions import text as X


def _blanked(s):
    out, i = [], 0
    while i < len(s):
        end = -1
        if s.startswith("/*", i):
            j = s.find("*/", i + 2)
            end = j + 2 if j >= 0 else -1
        elif s.startswith("//", i):
            j = s.find("\n", i)
            end = j if j >= 0 else len(s)
        elif s[i] in "\"'":
            j = i + 1
            while j < len(s) and s[j] not in (s[i], "\n"):
                j += 2 if s[j] == "\\" else 1
            end = j + 1 if j < len(s) and s[j] == s[i] else -1
        out.append(s[i] if end < 0 else " ")
        i = i + 1 if end < 0 else end
    return "".join(out)


def test_noise_of_any_length(spark):
    long = ['a "' + "x" * 300_000 + '" b', "a '" + "\\n" * 150_000 + "' b", "a /*" + "* x" * 150_000 + "*/ b", 'a "' + "y" * 300_000 + "\nb"]
    rng = random.Random(3)
    texts = long + ["".join(rng.choice("/*\"'\\\nab") for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.blank_noise(F.col("t")).alias("b")).collect()
    assert [(r.i, r.b) for r in rows if r.b != _blanked(texts[r.i])] == []
