"""String and parsing expressions: feature names, barcodes, edges, path keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: levels that the first letter of an interaction type stands for
LEVELS = {"a": "activation", "d": "dna", "t": "mrna", "p": "protein"}
# fixed values: what the second sign stands for
SIGNS = {">": 1.0, "|": -1.0}
# fixed values: order of the levels of one gene
DOGMA = ("dna", "mrna", "protein", "activation")
# fixed values: noise model, level and edge sign of each assay
ASSAYS = {
    "mutation": ("bernoulli_sq_hinge", "dna", -1.0),
    "methylation": ("normal", "mrna", -1.0),
    "mrnaseq": ("normal", "mrna", 1.0),
    "cna": ("ordinal_sq_hinge3", "dna", 1.0),
    "rppa": ("normal", "protein", 1.0),
}


def lookup(table: dict[str, object]) -> Column:
    """A literal map; index it with a column."""
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def feature_gene(name: Column) -> Column:
    return F.split(name, "_")[0]


def feature_assay(name: Column) -> Column:
    return F.element_at(F.split(name, "_"), -1)


def compound(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def barcode_batch(barcode: Column) -> Column:
    """Last two tokens between hyphens; '' stays ''."""
    tokens = F.split(barcode, "-")
    return F.when(barcode == "", "").otherwise(F.array_join(F.slice(tokens, F.greatest(F.size(tokens) - 1, F.lit(1)), 2), "-"))


def edge_source(node: Column) -> Column:
    return F.concat(node, F.lit("_activation"))


def edge_target(node: Column, kind: Column) -> Column:
    return F.concat(node, F.lit("_"), lookup(LEVELS)[F.substring(kind, 1, 1)])


def edge_weight(kind: Column) -> Column:
    return lookup(SIGNS)[F.substring(kind, 2, 1)]


def data_edge_target(feature: Column) -> Column:
    return F.substring_index(feature, "_", 2)


def interaction_code(name: Column) -> Column:
    return F.when(name == "controls-expression-of", "t>").otherwise("a>")


def path_pairs(path: Column) -> Column:
    """array<struct<k,v>> of the k=v parts of a path, extension dropped; a repeated key gets '_+' appended."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\.[A-Za-z]+$", ""), "/|__"), lambda p: F.instr(p, "=") > 0)
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=", "").alias("v")))
    keys = F.transform(pairs, lambda p: p["k"])
    return F.transform(pairs, lambda p, i: F.struct(F.when(F.array_position(keys, p["k"]) - 1 < i, F.concat(p["k"], F.lit("_+"))).otherwise(p["k"]).alias("k"), p["v"].alias("v")))


def corruption_label(*levels: Column) -> Column:
    return F.format_string("_".join(["%.2f"] * len(levels)), *levels)


def display_name(name: Column, names: dict[str, str]) -> Column:
    """The name to show; names without one are shown as they are."""
    return F.coalesce(lookup(names)[name], name) if names else name


def option_value(text: str) -> object:
    """The value of an option as written: nothing, a bool, an int, a float, a list a:b:c, or the text."""
    if text in ("nothing", "None", ""):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return [option_value(t) for t in text.split(":")] if ":" in text else text


def options(known: dict[str, object], args: list[str]) -> dict[str, object]:
    """``known`` options updated by k=v arguments; unknown names are an error."""
    out = dict(known)
    for arg in args:
        name, _, text = arg.removeprefix("--").partition("=")
        if name not in known:
            raise ValueError(f"unknown option {name!r}; known: {sorted(known)}")
        out[name] = option_value(text)
    return out


def view_label(feature: Column, view: Column) -> Column:
    """Plain numbers get the view in front."""
    return F.when(feature.rlike("^[0-9]+$"), F.concat_ws("_", view, feature)).otherwise(feature)
