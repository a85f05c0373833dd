"""Language detection of a text column: rules, a model, and a policy that may abstain.

A model is a Detector: from a DataFrame it makes ranked scores per row. The native trigram model and Arrow-batched
models of any make share this interface; texts that rules answer never reach either.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbaloom.functions import content
from verbaloom.operators.ngram_model import NgramModel

SCORES = "array<struct<language:string,score:double>>"
#: detected, empty, non_linguistic, insufficient_text, low_confidence, ambiguous
STATUSES = ("detected", "empty", "non_linguistic", "insufficient_text", "low_confidence", "ambiguous")


@dataclass(frozen=True)
class Policy:
    """When to abstain, and which languages may answer. None of the limits is set by default."""

    min_letters: int | None = None
    min_score: float | None = None
    min_margin: float | None = None
    candidates: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.min_letters is not None and (isinstance(self.min_letters, bool) or not isinstance(self.min_letters, int) or self.min_letters < 1):
            raise ValueError(f"min_letters is a whole number of at least 1, not {self.min_letters!r}")
        for name in ("min_score", "min_margin"):
            value = getattr(self, name)
            if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float)) or value < 0):
                raise ValueError(f"{name} is a number of at least 0, not {value!r}")
        if isinstance(self.candidates, str) or self.candidates is not None and not self.candidates:
            raise ValueError("candidates is a list of codes, and not an empty one")

    @property
    def active(self) -> bool:
        return any(x is not None for x in (self.min_letters, self.min_score, self.min_margin, self.candidates))


class Detector(ABC):
    """ranked(df, id, text): (id, scores), scores best first; texts that are null are not to be scored."""

    #: Codes the model knows; None where it can't say.
    labels: tuple[str, ...] | None = None

    def column(self, text: Column, top: int | None = None) -> Column | None:
        """The scores (the first `top` of them) as a column of the text's own row; None if the model needs a join."""
        return None

    @abstractmethod
    def ranked(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame: ...


@dataclass(frozen=True)
class NgramDetector(Detector):
    model: NgramModel

    @property
    def labels(self) -> tuple[str, ...]:  # type: ignore[override]
        return self.model.languages

    def ranked(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return self.model.ranked(df.where(F.col(text_col).isNotNull()), id_col, text_col)

    def column(self, text: Column, top: int | None = None) -> Column | None:
        return None if self.model.arrays is None or not self.model.languages else self.model.scores_column(text, top)


@dataclass(frozen=True)
class BatchDetector(Detector):
    """Any function from texts to score lists, in Arrow batches. opener() runs once for each Python worker task."""

    opener: Callable[[], Callable[[list[str]], list[list[tuple[str, float]]]]]
    labels: tuple[str, ...] | None = None
    batch_size: int = 256

    def __post_init__(self) -> None:
        if isinstance(self.batch_size, bool) or not isinstance(self.batch_size, int) or self.batch_size < 1:
            raise ValueError(f"batch_size is a whole number of at least 1, not {self.batch_size!r}")

    def column(self, text: Column, top: int | None = None) -> Column:
        opener, size = self.opener, self.batch_size
        axis = None if self.labels is None else {x: i for i, x in enumerate(self.labels)}
        # Equal scores come in the order of the model's own axis; without one, by label.
        order = (lambda s: (-s[1], s[0])) if axis is None else (lambda s: (-s[1], axis.get(s[0], len(axis)), s[0]))

        @F.pandas_udf(SCORES)
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            predict = opener()
            for batch in batches:
                out: list = [None] * len(batch)
                some = [i for i, t in enumerate(batch) if t is not None]
                some.sort(key=lambda i: len(batch.iloc[i]))  # texts of like length go together
                for k in range(0, len(some), size):
                    part = some[k : k + size]
                    for i, scores in zip(part, predict([batch.iloc[i] for i in part]), strict=True):
                        out[i] = [{"language": a, "score": float(b)} for a, b in sorted(scores, key=order)[:top]]
                yield pd.Series(out)

        return score(text)

    def ranked(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return df.where(F.col(text_col).isNotNull()).select(id_col, self.column(F.col(text_col)).alias("scores"))


def restrict(scores: Column, candidates: Iterable[str] | None) -> Column:
    """Scores of the candidates only, as they were."""
    return scores if candidates is None else F.filter(scores, lambda x: x.language.isin(*candidates))


def decide(rule: Column, letters: Column, scores: Column, policy: Policy) -> Column:
    """struct<language, status, top_language, score>: rules, letters, no answer, score, margin, in this order."""
    top, second = F.get(scores, F.lit(0)), F.get(scores, F.lit(1))
    none = top.isNull() | (top.language == "und")
    short = letters < policy.min_letters if policy.min_letters is not None else F.lit(False)
    weak = top.score < policy.min_score if policy.min_score is not None else F.lit(False)
    close = top.score - F.coalesce(second.score, F.lit(0.0)) < policy.min_margin if policy.min_margin is not None else F.lit(False)
    status = (
        F.when(rule == "und", "empty").when(rule == "zxx", "non_linguistic").when(short, "insufficient_text")
        .when(none | weak, "low_confidence").when(close, "ambiguous").otherwise("detected")
    )
    seen = rule.isNull() & ~short
    language = F.when(rule.isNotNull(), rule).when(status == "detected", top.language).otherwise("und")
    return F.struct(language.alias("language"), status.alias("status"), F.when(seen, top.language).alias("top_language"), F.when(seen, top.score).alias("score"))


@dataclass(frozen=True)
class LanguageDetection:
    """Applies a detector to a column under a policy."""

    detector: Detector
    policy: Policy = field(default_factory=Policy)

    def __post_init__(self) -> None:
        if self.policy.candidates is not None and self.detector.labels is not None:
            unknown = sorted(set(self.policy.candidates) - set(self.detector.labels))
            if unknown:
                raise ValueError(f"the model doesn't know {', '.join(unknown)}")

    def columns(self, df: DataFrame, id_col: str | None, text_col: str, scores: str, detection: str, top: int | None = None) -> DataFrame:
        """df with the named columns: the scores (rule texts: their label with 1.0) and the decision."""
        text = F.col(text_col)
        held = set(df.columns) | {scores, detection}
        rule, letters, key = (free_name(held, x) for x in ("_rule", "_letters", "_key"))
        marked = df.withColumns({rule: content.rule_label(text), **({letters: content.letter_count(text)} if self.policy.min_letters else {})})
        reach = F.col(rule).isNull()
        if self.policy.min_letters:
            reach = reach & (F.col(letters) >= self.policy.min_letters)
        asked = F.when(reach, text)
        column = self.detector.column(asked, top if self.policy.candidates is None else None)
        if column is not None:
            scored = marked.withColumn(scores, column)
        elif id_col is None:
            raise ValueError("a model that needs a join needs an id column")
        else:
            found = self.detector.ranked(marked.select(id_col, asked.alias("_asked")).where("_asked IS NOT NULL"), id_col, "_asked")
            scored = marked.join(found.select(F.col(id_col).alias(key), F.col("scores").alias(scores)), F.col(id_col) == F.col(key), "left").drop(key)
        few = F.col(letters) if self.policy.min_letters else F.lit(0)
        scored = scored.withColumn(scores, restrict(F.col(scores), self.policy.candidates))
        scored = scored.withColumn(detection, decide(F.col(rule), few, F.col(scores), self.policy))
        shown = F.when(F.col(rule).isNotNull(), F.array(F.struct(F.col(rule).alias("language"), F.lit(1.0).alias("score")))).otherwise(F.col(scores))
        return scored.withColumn(scores, shown).drop(rule, *([letters] if self.policy.min_letters else []))

    def detect(self, df: DataFrame, id_col: str, text_col: str, top: int | None = None) -> DataFrame:
        """df with _scores (the first `top` of them) and _detection in place of columns so called.

        Models that score row by row take each row as it is; one that needs a join takes rows of one id as one text.
        """
        return self.columns(df, id_col, text_col, "_scores", "_detection", top)

    def with_language(self, df: DataFrame, id_col: str | None, text_col: str, result_col: str, *, with_score: bool = False, detailed: bool = False, top_k: int | None = 5, status_col: str | None = None) -> DataFrame:
        """df with the label, the top_k scores or the whole decision, and the status if named; one pass of the model serves all.

        Without scores only the two best are asked for, which is what a margin needs. All other columns stay.
        """
        if top_k is not None and (isinstance(top_k, bool) or not isinstance(top_k, int) or top_k < 1):
            raise ValueError("top_k is at least 1, or None for all")
        if with_score and detailed:
            raise ValueError("either with_score or detailed, not both")
        scores, detection = free_name({*df.columns, result_col, status_col}, "_scores"), free_name({*df.columns, result_col, status_col}, "_detection")
        found = self.columns(df, id_col, text_col, scores, detection, top_k and max(top_k, 2) if with_score else 2)
        result = F.col(detection) if detailed else F.col(detection).language if not with_score else F.col(scores) if top_k is None else F.slice(scores, 1, top_k)
        out = found.withColumn(result_col, result)
        if status_col:
            out = out.withColumn(status_col, F.col(detection).status)
        return out.drop(scores, detection)


def free_name(held, wanted: str) -> str:
    """wanted, or something like it that is in use nowhere."""
    used = {x.lower() for x in held if x}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def label_axis(labels: Iterable[str], code: Callable[[str], str]) -> tuple[str, ...]:
    """The codes of a model's labels: in the labels' order where each has a code of its own, else sorted and each once."""
    codes = [code(x) for x in labels]
    return tuple(codes) if len(set(codes)) == len(codes) else tuple(sorted(set(codes)))


def default_policy() -> Policy:
    """What decides sources for translation where the caller names no policy."""
    return Policy(min_letters=4, min_score=0.5)


def collapse_scores(scores: DataFrame, keys: list[str], code: Column) -> DataFrame:
    """Scores of labels that share a code are summed."""
    return scores.withColumn("language", code).groupBy(*keys, "language").agg(F.sum("score").alias("score"))


def as_json_line(text: Column, detection: Column) -> Column:
    """{"text", "language", "status", "top_language", "score"}, nulls included."""
    return F.to_json(F.struct(text.alias("text"), *[detection[c].alias(c) for c in ("language", "status", "top_language", "score")]), {"ignoreNullFields": "false"})
