import pytest

from stratapanel import spec
from stratapanel.errors import ArchitectureMismatchError, MissingHyperparameterError, PredictionHorizonError, TemporalDiscontinuityError
from stratapanel.spec import Partition


@pytest.mark.parametrize(("test", "steps", "n"), [((445, 480), 12, 25), ((100, 111), 12, 1), ((100, 110), 12, None), ((100, 105), 36, None)])
def test_origins(test, steps, n):
    p = Partition((1, test[0] - 1), test)
    if n is None:
        with pytest.raises(ValueError):
            p.origins(steps)
    else:
        assert p.origins(steps) == n


@pytest.mark.parametrize("test", [(202, 210), (200, 210)])
def test_continuity(test):
    with pytest.raises(TemporalDiscontinuityError):
        Partition((100, 200), test).check_continuity()
    assert Partition((100, 200), (201, 210)).check_continuity().train == (100, 200)
    assert Partition((100, 200)).check_continuity().test is None


def test_horizon():
    Partition((1, 444), (445, 492)).check_horizon("calibration", 36, 12)
    with pytest.raises(PredictionHorizonError):
        Partition((1, 100), (101, 110)).check_horizon("calibration", 10, 2)
    Partition((1, 100), (101, 110)).check_horizon("forecasting", 10, 2)


def test_validation_is_carved_when_short():
    fit, held, carved = Partition((1, 100), (101, 112)).validation(24, 36)
    assert (fit.train, held, carved) == ((1, 64), (41, 100), True)
    assert Partition((1, 100), (101, 136)).validation(24, 36)[1:] == ((77, 136), False)


def manifest(**changes):
    base = dict.fromkeys(spec.required_keys({"algorithm": "NLinearModel", "optimizer_cls": "Adam", "lr_scheduler_cls": "StepLR", "loss_function": "WeightedHuberLoss"}), 1)
    base |= {"algorithm": "NLinearModel", "optimizer_cls": "Adam", "lr_scheduler_cls": "StepLR", "loss_function": "WeightedHuberLoss", "steps": list(range(1, 37)), "output_chunk_length": 12}
    return base | changes


def test_manifest():
    spec.audit_manifest(manifest())
    for bad in ({"delta": None}, {"algorithm": "Oracle"}, {"loss_function": "SmoothL1Loss"}):
        with pytest.raises(MissingHyperparameterError):
            spec.audit_manifest(manifest(**bad))
    lacking = manifest()
    del lacking["lr"]
    with pytest.raises(MissingHyperparameterError):
        spec.audit_manifest(lacking)
    nhits = manifest(algorithm="NHiTSModel")
    nhits |= {k: None if k in spec.NULLABLE else 1 for k in spec.required_keys(nhits) if k not in nhits}
    spec.audit_manifest(nhits)
    assert spec.unknown_keys(manifest(colour=1)) == ["colour"]


def test_architecture():
    spec.audit_architecture(manifest())
    with pytest.raises(ArchitectureMismatchError):
        spec.audit_architecture(manifest(output_chunk_length=7))
    assert isinstance(ArchitectureMismatchError("x"), ValueError)


def test_all_algorithms_have_genomes():
    assert len(spec.ALGORITHMS) == 10 and spec.RUNNABLE <= set(spec.ALGORITHMS) and spec.STATIC <= set(spec.ALGORITHMS)


def test_entropy():
    assert spec.lock_entropy(3).random() == spec.lock_entropy(3).random()
