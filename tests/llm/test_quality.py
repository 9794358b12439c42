"""Fences hold when many documents of a source are bad, and leave clean documents alone."""
import pytest

from pixelloom.llm import quality

KIND = "doc_id bigint, text string, lang string, source string"


def clean(i):
    return " ".join(f"word{(i * 31 + j * j) % 5003}" for j in range(100))


def symbols(i):
    words = clean(i).split()
    return " ".join(w + "#$" if j % 3 < 2 else w for j, w in enumerate(words))


def lines(i):
    return "\n".join([clean(i)] + [f"menu {i}", f"home {i}"] * 4)


def repeats(i):
    return " ".join(clean(i).split()[:60] + [f"a{i} b{i} c{i}"] * 10)


def shouts(i):
    words = clean(i).split()
    return " ".join(w.upper() if j % 2 else w for j, w in enumerate(words))


@pytest.mark.parametrize("bad, metric", [(symbols, "symbol_ratio"), (lines, "dup_ratio"), (repeats, "repeat_ratio"), (shouts, "upper_ratio")])
@pytest.mark.parametrize("share", [12, 40])
def test_bad_share_of_a_source_is_rejected(spark, bad, metric, share):
    rows = [(i, clean(i), "en", f"s{i % 4}") for i in range(800)]
    rows += [(1000 + i, bad(i) if i < 2 * share else clean(i), "en", "hot") for i in range(200)]
    df = spark.createDataFrame(rows, KIND)
    kept = {r["doc_id"] for r in quality.quality_report(df).filter("kept").collect()}
    assert kept == {r[0] for r in rows} - {1000 + i for i in range(2 * share)}
    counts = {r["source"]: r for r in quality.rejections(df).collect()}
    assert counts["hot"][metric] == 2 * share and counts["hot"]["kept"] == 200 - 2 * share and counts["hot"]["base"] == 0
    assert all(counts[f"s{k}"]["kept"] == counts[f"s{k}"]["n"] == 200 for k in range(4))


def test_a_source_that_differs_as_a_whole_keeps_its_own_fence(spark):
    rows = [(i, clean(i), "en", f"s{i % 4}") for i in range(400)] + [(1000 + i, symbols(i), "en", "code") for i in range(100)]
    assert quality.quality_report(spark.createDataFrame(rows, KIND)).filter("kept").count() == 500


def test_fences_follow_their_sources(spark):
    """Two sources of different habits have different fences, and a source that shifts takes its fence with it."""
    some = lambda i, every: " ".join(w + "#" if (j + i) % every == 0 else w for j, w in enumerate(clean(i).split()))

    def table(every):
        rows = [(i, some(i, 20 + i % 5), "en", "plain") for i in range(200)] + [(1000 + i, some(i, every + i % 3), "en", "code") for i in range(200)]
        out = quality.fences(quality.with_metrics(spark.createDataFrame(rows, KIND)))
        return {r["f_source"]: r["fence"] for r in out.collect()}

    a, b = table(10), table(4)
    assert a["code"]["symbol_ratio"] > 1.5 * a["plain"]["symbol_ratio"] and b["code"]["symbol_ratio"] > 2 * a["code"]["symbol_ratio"]
    assert a["code"]["symbol_ratio_max"] != a["plain"]["symbol_ratio_max"] and b["code"]["symbol_ratio_max"] > a["code"]["symbol_ratio_max"]


def test_a_document_with_one_repeated_line_or_few_symbols_is_kept(spark):
    rows = [(i, clean(i), "en", f"s{i % 4}") for i in range(400)] + [(1000, clean(3) + "\nfoot\nfoot", "en", "s1"), (1001, "# " + clean(4) + " *", "en", "s1"), (1002, "\n".join([clean(5)] * 2 + [clean(k) for k in range(6, 9)]), "en", None)]
    assert quality.quality_report(spark.createDataFrame(rows, KIND)).filter("kept").count() == 403
