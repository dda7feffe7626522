from linearspark.functions.columns import (  # noqa: F401
    OUT_DIGITS,
    fixed_weight,
    hash_prefix,
    hash_text,
    hinge,
    is_support,
    logistic_factor,
    out,
    pct_text,
    predict_sign,
    predict_threshold,
    secs_text,
    stable_margin,
    ts_text,
    uniform,
)
