import pytest
from pyspark.sql import functions as F

from leafwork.functions import grammar as G

CASES = [
    (lambda c: G.squeeze_blank_lines(c), "a\n\n\n\nb", "a\n\nb"),
    (lambda c: G.lemma_head(c)["last"], "12-14. le mot", 14),
    (lambda c: G.lemma_head(c)["label"], "12-14. le mot", "le mot"),
    (lambda c: G.lemma_head(c)["open"], "v. 12 ss. le mot", True),
    (lambda c: G.lemma_head(c)["first"], "le mot", None),
    (lambda c: F.to_json(G.reference_list(c)), "XX, 43; passim; XIX, 5, 7; note", '[{"song":"XX","verse":43},{"song":"XIX","verse":5},{"song":"XIX","verse":7}]'),
    (lambda c: G.preceding(c, F.lit("(abr")), "*Un*, puis *Deux* (abrégé)", "*Deux*"),
    (lambda c: G.preceding(c, F.lit("zz")), "*Un*", None),
    (lambda c: G.around(c, "mot", 3, 2)[0], "dans un mot clef", "un mot c"),
    (lambda c: G.parallels(c)[1]["verse"], "a / b\nc / d (v. 3)\ne", "3"),
    (lambda c: G.parallels(c)[0]["right"], "a / b\nc / d (v. 3)\ne", "b"),
    (lambda c: G.dedent(c), "    a\n\n      b", "a\n\n  b"),
    (lambda c: F.array_join(G.notes_once(c), ","), "x[^2] y[^1] z[^2]", "2,1"),
    (lambda c: F.array_join(G.linked_tokens(c, F.array(F.lit("St.Bra"), F.lit("RO"))), ","), "voir RO et St.Bra. x", "St.Bra,RO"),
    (lambda c: G.render(c), "# A\n\n*b* & [c]{.u}\nd\n\n::: {.v}\nx\ny\n:::", '<h1>A</h1>\n<p><em>b</em> &amp; <span class="u">c</span> d</p>\n<blockquote>x<br>y</blockquote>'),
]


@pytest.fixture(scope="module")
def answers(spark):
    cols = [f(F.lit(t)).alias(f"c{i}") for i, (f, t, _) in enumerate(CASES)]
    none = [f(F.lit(None).cast("string")).alias(f"n{i}") for i, (f, _, _) in enumerate(CASES)]
    return spark.range(1).select(*cols, *none).first()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(answers, i):
    assert answers[f"c{i}"] == CASES[i][2]
