"""Arithmetic on small per-row arrays (class scores, probabilities)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it by name in ``body``.

    A Column used twice is computed twice, and inside a lambda once per element; binding it as
    a lambda variable keeps array arithmetic linear."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def argmax(scores: Column | str) -> Column:
    """0-based position of the first maximum."""
    if isinstance(scores, str):
        return _first_max(F.col(scores))
    return let(scores, _first_max)


def _first_max(s: Column) -> Column:
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def array_total(values: Column | str) -> Column:
    """Sum in array order."""
    return F.aggregate(_col(values), F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def _scaled(logits: Column | str, temperature: float) -> Column:
    return F.transform(_col(logits), lambda v: v.cast("double") / F.lit(float(temperature)))


def softmax(logits: Column | str, temperature: float = 1.0) -> Column:
    """Softmax, shifted by the maximum so that it cannot overflow."""

    def exps(z: Column) -> Column:
        return let(F.array_max(z), lambda top: F.transform(z, lambda v: F.exp(v - top)))

    return let(
        let(_scaled(logits, temperature), exps),
        lambda e: let(array_total(e), lambda total: F.transform(e, lambda v: v / total)),
    )


def log_softmax(logits: Column | str, temperature: float = 1.0) -> Column:
    def shifted(z: Column) -> Column:
        return let(F.array_max(z), lambda top: F.transform(z, lambda v: v - top))

    def less_norm(z: Column) -> Column:
        norm = F.ln(array_total(F.transform(z, lambda v: F.exp(v))))
        return let(norm, lambda n: F.transform(z, lambda v: v - n))

    return let(let(_scaled(logits, temperature), shifted), less_norm)


def log_probs(probs: Column | str, floor: float = 1e-12) -> Column:
    """Logarithm of probabilities, clipped from below."""
    return F.transform(
        _col(probs), lambda p: F.ln(F.least(F.greatest(p.cast("double"), F.lit(floor)), F.lit(1.0)))
    )


def cross_entropy(logits: Column | str, label: Column | str) -> Column:
    """-log softmax(logits)[label] (``label`` is 0-based)."""
    return -F.get(log_softmax(logits), _col(label).cast("int"))


def distillation_loss(
    student: Column | str,
    teacher: Column | str,
    label: Column | str,
    temperature: float,
    alpha: float,
) -> Column:
    """alpha * T^2 * KL(teacher || student) at temperature T + (1 - alpha) * cross entropy."""
    terms = F.zip_with(
        log_softmax(teacher, temperature), log_softmax(student, temperature),
        lambda t, s: F.exp(t) * (t - s),
    )
    return (
        F.lit(alpha * temperature * temperature) * array_total(terms)
        + F.lit(1.0 - alpha) * cross_entropy(student, label)
    )


def label_index(label: Column | str, labels: list[str]) -> Column:
    """0-based position in the ordered label list; an unknown label stops the job."""
    c = _col(label)
    pos = F.array_position(F.array(*[F.lit(v) for v in labels]), c)
    shown = F.coalesce(c.cast("string"), F.lit("NULL"))
    stop = F.raise_error(F.concat(F.lit("label outside the declared list: "), shown))
    return F.when(pos > 0, (pos - 1).cast("int")).otherwise(stop.cast("int"))
