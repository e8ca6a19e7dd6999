import pytest

from complaintlens.options import JobOptions


def test_defaults():
    o = JobOptions()
    assert (o.top_k, o.chunk_size, o.chunk_overlap, o.max_answer_tokens) == (5, 500, 50, 512)
    assert (o.temperature, o.batch_rows, o.vector_width) == (0.7, 50_000, 384)


@pytest.mark.parametrize(
    "wrong",
    [
        {"top_k": 0}, {"top_k": 21}, {"chunk_size": 49}, {"chunk_overlap": 500},
        {"max_answer_tokens": 63}, {"temperature": 2.1}, {"temperature": -0.1},
    ],
)
def test_wrong_values_are_refused(wrong):
    with pytest.raises(ValueError, match=next(iter(wrong))):
        JobOptions(**wrong)


def test_limits_are_allowed():
    JobOptions(top_k=20, chunk_size=50, chunk_overlap=49, max_answer_tokens=64, temperature=0.0)
