"""Openers of third-party detectors, for BatchDetector. Their packages are needed where they run, not to import this."""

from __future__ import annotations

from collections.abc import Callable, Iterable

Scores = list[list[tuple[str, float]]]
Opener = Callable[[], Callable[[list[str]], Scores]]


def lingua(candidates: Iterable[str] | None = None, *, low_accuracy: bool = False, preload: bool = False) -> Opener:
    """Relative confidences of lingua by ISO 639-3 code; labels without any are left out, and if none has any the answer is und."""
    wanted = None if candidates is None else sorted(set(candidates))

    def open_model():
        import lingua as package

        builder = package.LanguageDetectorBuilder
        if wanted is None:
            b = builder.from_all_languages()
        else:
            by_code = {x.iso_code_639_3.name.lower(): x for x in package.Language.all()}
            b = builder.from_languages(*[by_code[c] for c in wanted])
        b = b.with_low_accuracy_mode() if low_accuracy else b
        model = (b.with_preloaded_language_models() if preload else b).build()

        def predict(texts: list[str]) -> Scores:
            found = [[(v.language.iso_code_639_3.name.lower(), v.value) for v in model.compute_language_confidence_values(t)] for t in texts]
            return [[x for x in scores if x[1] > 0] or [("und", 1.0)] for scores in found]

        return predict

    return open_model


def cld3(k: int = 3, min_bytes: int = 0, max_bytes: int = 1000) -> Opener:
    """The k likeliest languages of spans of a text: probabilities of the spans, which don't add up to 1."""

    def open_model():
        import gcld3

        model = gcld3.NNetLanguageIdentifier(min_num_bytes=min_bytes, max_num_bytes=max_bytes)

        def predict(texts: list[str]) -> Scores:
            return [[(r.language, r.probability) for r in model.FindTopNMostFreqLangs(text=t, num_langs=k)] for t in texts]

        return predict

    return open_model


def heliport() -> Opener:
    """The one likeliest language and its confidence, which has no upper bound."""

    def open_model():
        import heliport as package

        model = package.Identifier()

        def predict(texts: list[str]) -> Scores:
            return [[(str(code), float(score))] for code, score in (model.identify_with_score(t) for t in texts)]

        return predict

    return open_model
