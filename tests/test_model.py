import pytest

from ledgerloom.model import EngineConfig, PersistenceConfig, PipelineSpec, Watermarks


def test_defaults():
    spec = PipelineSpec("ledger", "topic")
    assert (spec.concurrency, spec.watermarks, spec.persistence) == (3, Watermarks(50_000, 20_000), PersistenceConfig(1_000, 5))


@pytest.mark.parametrize("make", [lambda: PersistenceConfig(batch_size=0), lambda: PersistenceConfig(max_retries=-1), lambda: Watermarks(2, 2), lambda: Watermarks(5, -1), lambda: PipelineSpec("", "t"), lambda: PipelineSpec("n", " "), lambda: PipelineSpec("n", "t", concurrency=0)])
def test_refused(make):
    with pytest.raises(ValueError):
        make()


def test_overrides_by_name():
    config = EngineConfig(overrides={"slow": {"persistence": {"batch_size": 5}, "watermarks": {"high": 10, "low": 2}, "concurrency": 1}})
    slow, other = config.spec("slow", "t"), config.spec("other", "t")
    assert (slow.persistence.batch_size, slow.persistence.max_retries, slow.watermarks, slow.concurrency) == (5, 5, Watermarks(10, 2), 1)
    assert other == PipelineSpec("other", "t")
