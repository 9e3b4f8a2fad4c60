from foldwise.functions.scalar import (
    argmax_code,
    clip,
    hard_label,
    logit,
    parse_regime,
    uniform,
)

__all__ = ["argmax_code", "clip", "hard_label", "logit", "parse_regime", "uniform"]
