"""Small tables with the awkward cases that every operator has to define."""

import random

WORDS = "the of and to in that it is was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.6 else "") for _ in range(n))


def texts(seed: int = 3) -> list:
    """Prose, copies, near copies, shared lines and passages, empty, null and long texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.choice((3, 20, 80, 200, 400))) for _ in range(40)]
    passage = prose(rng, 70)
    shared = [f"  Shared LINE {k}\t" for k in range(3)]
    out = list(base)
    out += [f"{prose(rng, 30)}\n{shared[k % 3]}\n{prose(rng, 10)}" for k in range(36)]
    out += [f"{prose(rng, k)} {passage} {prose(rng, 5)}" for k in range(12)]
    out += base[3:8] + [b + " tail" for b in base[4:9]] + [base[4].upper()] * 2
    out += [None, "", "", " \t\n\x0b\x0c\r ", "\n\n\n", "a", "a b", "a b c", "éÉ   x y \U0001f600", "word " * 130, " ".join(str(i) for i in range(60_000))]
    return out


def documents(spark, rows=None, extra=True):
    """Documents with null ids, sources and repeats, and with columns whose names clash."""
    if rows is None:
        found = texts()
        rows = [(i * 3 + 1, t, "en" if i % 2 else None, None if i % 11 == 0 else f"src{i % 4}", len(t or "")) for i, t in enumerate(found)]
        rows += rows[5:8]
        rows.append((None, found[10], "de", "src0", 5))
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        names = ["_id", "_mark", "_at", "_own", "_t", "_w", "_s", "_times", "_copy", "fp", "node", "label", "size", "pos", "key", "line", "id", "mark", "words", "taken", "score.x", "cell", "spans", "bin", "n_lines", "n_dropped", "score", "held_out", "predicted", "component_id", "slot", "shard", "copy", "first_slot", "part", "copies", "base", "links"]
        out = out.withColumns({n: F.lit(1) for n in names})
    return out.repartition(3)


def empty(spark):
    return documents(spark, [], extra=False)
