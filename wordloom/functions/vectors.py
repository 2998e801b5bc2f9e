"""Expressions over ARRAY<FLOAT|DOUBLE> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wordloom.settings import LAYER_EPS, RMS_EPS


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once per row.  A plain column used inside a
    lambda would be evaluated again for every array element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x)


def square_sum(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """NULL where a vector is zero: it has no direction."""
    size = F.sqrt(square_sum(a)) * F.sqrt(square_sum(b))
    return F.when(size > 0, dot(a, b) / size)


def _affine(vec: Column, weight: Column | None, bias: Column | None) -> Column:
    if weight is not None:
        vec = F.zip_with(vec, weight, lambda x, w: x * w)
    if bias is not None:
        vec = F.zip_with(vec, bias, lambda x, b: x + b)
    return vec


def rms_norm(vec: Column, weight: Column | None = None, eps: float = RMS_EPS) -> Column:
    """weight * x / sqrt(mean(x^2) + eps)"""
    scale = F.sqrt(square_sum(vec) / F.size(vec) + eps)
    return _affine(bind(scale, lambda s: F.transform(vec, lambda x: x / s)), weight, None)


def layer_norm(
    vec: Column, weight: Column | None = None, bias: Column | None = None, eps: float = LAYER_EPS
) -> Column:
    """Centre, divide by sqrt(population variance + eps), then weight and bias."""

    def scaled(centred: Column) -> Column:
        scale = F.sqrt(square_sum(centred) / F.size(centred) + eps)
        return bind(scale, lambda s: F.transform(centred, lambda x: x / s))

    mean = total(vec) / F.size(vec)
    centred = bind(mean, lambda m: F.transform(vec, lambda x: x - m))
    return _affine(bind(centred, scaled), weight, bias)


def softmax(logits: Column) -> Column:
    """Class probabilities; the maximum is subtracted first."""
    powers = bind(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return bind(powers, lambda p: bind(total(p), lambda mass: F.transform(p, lambda x: x / mass)))


def argmax(logits: Column) -> Column:
    """Position of the first maximum, from 0."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def cross_entropy(logits: Column, label: Column) -> Column:
    """log-sum-exp of the logits minus the logit of the true class."""
    log_mass = bind(
        F.array_max(logits),
        lambda top: F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))) + top,
    )
    return log_mass - F.element_at(logits, label + 1)
