"""The features that models may take, named subsets of them, and the matrix that a model sees."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.operators import aggregates as A

NUMERIC = ("living_area", "rooms", "construction_year", "floor", "monthly_fee", "area_p50", "area_n", "encoded_area", "price_median", "price_volatility", "dom_median", "energy", "quality", "month_sin", "month_cos", "timing", "property_age", "listing_price", "price_per_sqm")
CATEGORICAL = ("area", "size_band", "era", "season")
#: Features that follow from the asking price; a model for homes without one must not take them.
ASKING = frozenset({"listing_price", "price_per_sqm", "price_change", "fee_price_interaction", "value_score", "total_cost_per_sqm", "luxury_score"})
_NO_LIST = [c for c in NUMERIC if c not in ASKING]
SUBSETS: Mapping[str, Any] = {
    "default": "no_list_price",
    "no_list_price": {"numeric": _NO_LIST, "categorical": list(CATEGORICAL)},
    "with_list_price": {"numeric": [*_NO_LIST, "listing_price"], "categorical": list(CATEGORICAL)},
    "compact": {"numeric": ["living_area", "rooms", "area_p50", "encoded_area", "timing"], "categorical": ["area", "size_band"]},
}


def subset(name: str | None = None, config: Mapping[str, Any] = SUBSETS, numeric: Sequence[str] = NUMERIC, categorical: Sequence[str] = CATEGORICAL) -> tuple[list[str], list[str]]:
    """The numeric and categorical features of a named subset; `full` is all, no name is the config's default.

    An unknown subset, one that isn't two lists of names, and names that are
    unknown, repeated or empty are errors that say what is wrong.
    """
    if not isinstance(config, Mapping):
        raise ValueError("the config of subsets must be a mapping")
    if name is None:
        name = config.get("default")
        if not isinstance(name, str) or not name:
            raise ValueError("the config names no default subset")
    if name == "full":
        return list(numeric), list(categorical)
    if name not in config or name == "default":
        raise ValueError(f"unknown subset {name!r}; known: {', '.join(sorted(k for k in config if k != 'default'))}, full")
    entry = config[name]
    if not isinstance(entry, Mapping) or not all(isinstance(entry.get(k), list | tuple) for k in ("numeric", "categorical")):
        raise ValueError(f"subset {name!r} must have a list numeric and a list categorical")
    got = {k: list(entry[k]) for k in ("numeric", "categorical")}
    if not all(isinstance(c, str) and c.strip() == c and c for names in got.values() for c in names):
        raise ValueError(f"subset {name!r} must hold names only")
    for k, known in (("numeric", numeric), ("categorical", categorical)):
        if unknown := sorted(set(got[k]) - set(known)):
            raise ValueError(f"subset {name!r} has unknown {k} features: {', '.join(unknown)}")
    if repeated := sorted(c for c, n in Counter(got["numeric"] + got["categorical"]).items() if n > 1):
        raise ValueError(f"subset {name!r} repeats: {', '.join(repeated)}")
    if not got["numeric"] and not got["categorical"]:
        raise ValueError(f"subset {name!r} is empty")
    return got["numeric"], got["categorical"]


@dataclass(frozen=True)
class Spec:
    """A model's name, its subset, and whether it needs an asking price."""

    name: str
    subset: str
    asking: bool

    def check(self, config: Mapping[str, Any] = SUBSETS) -> Spec:
        """Itself, if a model with asking prices sees them and one without sees none of what follows from them."""
        numeric, _ = subset(self.subset, config)
        hidden = sorted(ASKING.intersection(numeric))
        if self.asking and "listing_price" not in numeric:
            raise ValueError(f"{self.name}: subset {self.subset!r} lacks listing_price")
        if not self.asking and hidden:
            raise ValueError(f"{self.name}: subset {self.subset!r} holds signals of the asking price: {', '.join(hidden)}")
        return self


NO_LIST, WITH_LIST = Spec("no_list", "no_list_price", False), Spec("with_list", "with_list_price", True)


@dataclass(frozen=True)
class Context:
    """What a missing feature is taken for."""

    numeric: Mapping[str, float] = field(default_factory=dict)
    categorical: Mapping[str, str] = field(default_factory=dict)


def fit_context(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Context:
    """Exact medians (the lower of two) of the numeric features that df has, and `unknown` for categories."""
    here = [c for c in numeric if c in df.columns]
    if not here:
        return Context({}, {c: "unknown" for c in categorical})
    number = lambda c: F.nanvl(F.expr(f"try_cast(`{c}` AS double)"), F.lit(None))
    found = {r.column_name: r.middle for r in A.middles(df.select(*[number(c).alias(c) for c in here]), here).collect()}
    return Context({c: found[c] for c in here if c in found}, {c: "unknown" for c in categorical})


def matrix(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], context: Context, keep: Sequence[str] = ()) -> DataFrame:
    """keep and the features as doubles and strings without nulls: what can't be read and what is absent takes the context's value, 0 and `unknown` without one."""
    def number(c):
        known = F.expr(f"try_cast(`{c}` AS double)") if c in df.columns else F.lit(None).cast("double")
        return F.coalesce(F.when(~F.isnan(known), known), F.lit(float(context.numeric.get(c, 0.0)))).alias(c)

    def category(c):
        known = F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
        return F.coalesce(known, F.lit(context.categorical.get(c) or "unknown")).alias(c)

    return df.select(*[c for c in keep if c not in {*numeric, *categorical}], *map(number, numeric), *map(category, categorical))
