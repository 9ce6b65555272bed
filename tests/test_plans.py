"""Physical plans: pruning, pushdown and the absence of row shuffles."""

import os

import pytest

from tallgram.operators import algebra as A
from tallgram.operators.clustering import compute_centers, nearest_centroid
from tallgram.operators.errors import sketch_and_score, sq_frobenius
from tallgram.operators.kernels import Spec
from tallgram.operators.linear import count_sketch
from tallgram.operators.sketch import sketch
from tallgram.workload.registry import embeddings, labelled, line_matrix

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def below_first_kernel(text):
    """The part of the plan under the innermost Python kernel."""
    return text[text.rindex("MapInArrow") :]


def test_slices_reach_the_scan(spark):
    text = plan(A.truncate_rows(embeddings(spark, SF), 100))
    assert "LessThan(vec_id,100)" in text
    text = plan(A.row_slice(embeddings(spark, SF), 10, 20))
    assert "GreaterThanOrEqual(vec_id,10)" in text and "LessThanOrEqual(vec_id,20)" in text


def test_only_needed_columns_are_read(spark):
    text = plan(sketch(embeddings(spark, SF, "float"), Spec("fd", 8)))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in text
    assert "label" not in text
    text = plan(sq_frobenius(line_matrix(spark, SF)))
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_tax:double>" in text


def test_rows_are_not_shuffled_before_they_are_sketched(spark):
    text = plan(sketch(embeddings(spark, SF, "float"), Spec("fd", 8)))
    assert "Exchange" not in below_first_kernel(text)
    assert text.count("Exchange") == 1


def test_sketch_and_gram_share_one_scan(spark):
    df = sketch_and_score(embeddings(spark, SF, "float"), Spec("fd", 8))
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "Union" not in final


def test_a_gram_matrix_is_sent_once_for_several_grid_points(spark):
    specs = [Spec("fd", 4 + n, grid_id=n) for n in range(11)]
    df = sketch_and_score(embeddings(spark, SF, "float"), specs)
    assert [r.l for r in df.orderBy("grid_id").collect()] == [s.l for s in specs]
    assert all(r.err < 1 for r in df.collect())


def test_count_sketch_combines_before_the_exchange(spark):
    text = plan(count_sketch(embeddings(spark, SF), 16))
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1
    assert "Python" not in text and "Arrow" not in text


def test_assignment_is_narrow(spark):
    rows = labelled(spark, SF)
    text = plan(nearest_centroid(rows, compute_centers(rows)))
    assert "Exchange" not in text and "Join" not in text


def test_no_cartesian_products(spark):
    import __spark_entry__ as entry

    for name in ("matmul", "jlt_gaussian", "mat_add", "nearest_centroid", "fd_bounds", "left_vectors"):
        text = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
