"""Class-probability expressions on arrays (EXP-21 .. EXP-24)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from nightframe.functions.binding import bind


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def softmax(logits: Column, temperature: float | Column = 1.0) -> Column:
    """Softmax with the maximum subtracted, optionally tempered (EXP-21, EXP-22)."""
    t = F.greatest(
        temperature if isinstance(temperature, Column) else F.lit(float(temperature)), F.lit(1e-6)
    )

    def normalise(weights: Column) -> Column:
        return bind(total(weights), lambda s: F.transform(weights, lambda w: w / s))

    def shifted(z: Column) -> Column:
        return bind(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp((x - top) / t)))

    return bind(logits, lambda z: bind(shifted(z), normalise))


def linear_logits(vector: Column, weights: Column, bias: Column) -> Column:
    """``x . W + b`` for one weight row per class (EXP-21)."""
    return bind(vector, lambda x: F.zip_with(weights, bias, lambda w, b: dot(x, w) + b))


def argmax_label(probs: Column, labels: Sequence[str] | Column) -> Column:
    """Label of the largest probability, first index on ties (EXP-23)."""
    names = labels if isinstance(labels, Column) else F.array(*[F.lit(x) for x in labels])
    return F.element_at(names, F.array_position(probs, F.array_max(probs)).cast("int"))


def confidence_of(probs: Column, labels: Sequence[str], label: Column) -> Column:
    """Probability given to ``label``."""
    names = F.array(*[F.lit(x) for x in labels])
    return F.try_element_at(probs, F.array_position(names, label).cast("int"))


def output_labels(labels: Column, n_classes: Column) -> Column:
    """Labels cut to ``n_classes`` or extended with ``class_{i}`` (EXP-24)."""
    n = n_classes.cast("int")
    extra = F.when(
        n > F.size(labels),
        F.transform(
            F.sequence(F.size(labels), n - 1), lambda i: F.concat(F.lit("class_"), i.cast("string"))
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(F.slice(labels, F.lit(1), F.least(n, F.size(labels))), extra)


def log_loss(logits: Column, label_index: Column, temperature: Column) -> Column:
    """Negative log-likelihood of one row at a temperature."""

    def loss(scaled: Column) -> Column:
        norm = bind(
            F.array_max(scaled),
            lambda top: F.ln(total(F.transform(scaled, lambda z: F.exp(z - top)))) + top,
        )
        return norm - F.element_at(scaled, label_index.cast("int"))

    return bind(F.transform(logits, lambda z: z / temperature), loss)
