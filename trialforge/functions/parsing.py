"""Column functions that parse labels, file names, logs and model responses."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Load cases (combined ones before the ones they begin with) and view angles.
LOADS = ["bending_compression", "torsion_compression", "bending", "compression", "torsion"]
LOAD = "(" + "|".join(LOADS) + ")"


def method_of(candidate: Column, load_case: Column) -> Column:
    """The method family of a candidate label; null for unknown labels. The proposed method's label begins with the
    row's own load case."""
    own = F.expr("substring(candidate, length(load_case) + 1)")
    prompt = F.regexp_extract(own, r"^_gemini.*_geo_(max|mid|none)prompt_ortho_5views", 1)
    return (
        F.when(candidate.isin("coarse", "zz_coarse", "zz_oracle"), candidate)
        .when(candidate.startswith("heuristic_baseline_DENSE_") & candidate.endswith("_sub"), F.lit("heuristic_sub"))
        .when(candidate.startswith("heuristic_mech_") & candidate.endswith("_sub"), F.lit("mech_sub"))
        .when(candidate.startswith(load_case) & (prompt != ""), F.concat(F.lit("proposed_"), prompt))
    )


def level_of_name(name: Column) -> Column:
    """The sizing level in a mesh file's name; 1.0 where there is none. _hs2 is 2.0."""
    found = F.regexp_extract(name, r"_hs([0-9.]+?)(?:_fine2_mesh)?_refined", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("double"), F.lit(1.0))


def first_label(text: Column, table: list[tuple[str, str]]) -> Column:
    """The label of the first entry whose substring is in the text; null if none is."""
    out = F.lit(None).cast("string")
    for part, label in reversed(table):
        out = F.when(text.contains(part), label).otherwise(out)
    return out


EXPERIMENT = rf"^{LOAD}_(.+)_([a-z]+)prompt_([a-z]+)_([0-9]+)views_([0-9]+)grid_([0-9]+)run$"


def experiment_parts(name: Column) -> dict[str, Column]:
    """The seven parts of an experiment's name; empty where it isn't one."""
    names = ["load_case", "model", "prompt", "view_type", "k", "grid", "run"]
    return {n: F.regexp_extract(name, EXPERIMENT, i) for i, n in enumerate(names, 1)}


OLD_EXPERIMENT = r"^(.*?)_(ortho|random)_([0-9]+)views_([^_]+)_(?:.*_)?([0-9]+)grid_([0-9]+)neighbours_([0-9]+)run$"


def old_experiment_parts(name: Column) -> dict[str, Column]:
    """The parts of an experiment's name in the older grammar; empty where it isn't one."""
    names = ["mesh", "view_type", "k", "model", "grid", "neighbours", "run"]
    return {n: F.regexp_extract(name, OLD_EXPERIMENT, i) for i, n in enumerate(names, 1)}


def success_pair(line: Column) -> tuple[Column, Column]:
    """(object, experiment) of a line with [SUCCESS] and three parts or more between |; null for others."""
    parts = F.split(line, r"\|")
    ok = line.contains("[SUCCESS]") & (F.size(parts) >= 3)
    return F.when(ok, F.trim(F.substring_index(parts[0], "]", -1))), F.when(ok, F.trim(F.get(parts, F.lit(1))))


def experiment_name(load: Column, model: Column, prompt: Column, view: Column, k: Column, grid: Column, run: Column) -> Column:
    return F.format_string("%s_%s_%sprompt_%s_%dviews_%dgrid_%drun", load, model, prompt, view, k, grid, run)


def success_parts(line: Column) -> tuple[Column, Column, Column]:
    """(object, experiment, result) of a success line; result is a struct of coarse and refined errors."""
    head = r"^\[SUCCESS\] ([^|]+) \| ([^|]+) \| Result: (.*)$"
    text = F.regexp_replace(F.regexp_extract(line, head, 3), "'", '"')
    side = "struct<rel_L2: double, rel_energy: double>"
    return F.regexp_extract(line, head, 1), F.regexp_extract(line, head, 2), F.from_json(text, f"coarse {side}, refined {side}", {"allowNonNumericNumbers": "true"})


def block_numbers(text: Column, name: str) -> Column:
    """The integers of all ***name: ...*** blocks, in order; parts that aren't integers are left out."""
    inside = F.regexp_extract_all(text, F.lit(rf"\*\*\*{name}: ?([^*]*)\*\*\*"), 1)
    parts = F.flatten(F.transform(inside, lambda b: F.split(b, ",")))
    return F.transform(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.rlike("^[0-9]+$")), lambda p: p.cast("int"))


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or missing."""
    return F.when(b != 0, a / b)


#: How names end that carry a variant and a level, and what the codes mean.
VARIANTS = {"amberfd": "dense", "amberf": "fine"}
LEVEL_CODES = {"100": 1.0, "125": 1.25, "160": 1.6, "200": 2.0}


def code_label(code: Column, labels: dict) -> Column:
    """The label of a code; null for unknown ones."""
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[code]


def suffix_codes(name: Column) -> tuple[Column, Column]:
    """(variant, level) of a name that ends in a variant and a level code; null where it doesn't."""
    at = lambda i: F.regexp_extract(name, r"_(amberfd|amberf)_h([0-9]{3})$", i)
    return code_label(at(1), VARIANTS), code_label(at(2), LEVEL_CODES)


def object_and_load(name: Column) -> tuple[Column, Column]:
    """(object, load case) of a name object_loadcase: the longest load case that ends the name. Empty where none does."""
    pattern = rf"^(.+?)_{LOAD}$"
    return F.regexp_extract(name, pattern, 1), F.regexp_extract(name, pattern, 2)


def belongs_to_load(label: Column, load: str) -> Column:
    """Whether a label is one of a load case and not of a combined one that begins with it."""
    inside = label.startswith(load + "_") | (label == load)
    for other in LOADS:
        if other.startswith(load + "_"):
            inside = inside & ~label.startswith(other)
    return inside


def matches_glob(text: Column, pattern: str) -> Column:
    """Whether a whole text fits a shell pattern (*, ?, [...])."""
    return text.rlike("^" + fnmatch.translate(pattern))


def path_parts(path: Column) -> tuple[Column, Column, Column]:
    """(directory, file, file without its last extension) of a path."""
    file = F.substring_index(path, "/", -1)
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1), file, F.regexp_replace(file, r"\.[^.]*$", "")


def view_of_name(name: Column) -> tuple[Column, Column]:
    """(elevation, azimuth) of a view's name; null where it isn't one."""
    at = lambda i: F.nullif(F.regexp_extract(name, r"^view_e(-?[0-9]+)_a(-?[0-9]+)", i), F.lit("")).cast("int")
    return at(1), at(2)


def labelled_value(line: Column) -> tuple[Column, Column]:
    """(key, value) of a line `key: value`; null where the value isn't a number."""
    at = lambda i: F.regexp_extract(line, r"^\s*(.*?)\s*:\s*([-+0-9.eE]+)\s*$", i)
    return F.nullif(at(1), F.lit("")), F.nullif(at(2), F.lit("")).try_cast("double")


def before(text: Column, marker: str) -> Column:
    """What stands before the first marker, the whole text where there is none."""
    return F.substring_index(text, marker, 1)


def count_in_blocks(text: Column) -> Column:
    """How many integers stand inside ***...*** blocks of any name."""
    blocks = F.regexp_extract_all(text, F.lit(r"\*\*\*(.*?)\*\*\*"), 1)
    return F.aggregate(F.transform(blocks, lambda b: F.regexp_count(b, F.lit(r"\b[0-9]+\b"))), F.lit(0), lambda a, n: a + n)


def identified_cells(text: Column, first_only: Column) -> Column:
    """How many cells a dictionary of lists after `Identified cell numbers:` names, or its first list only; null where
    there is none."""
    found = F.regexp_replace(F.nullif(F.regexp_extract(text, r"Identified cell numbers: (\{[^}]*\})", 1), F.lit("")), "'", '"')
    sizes = F.transform(F.map_values(F.from_json(found, "map<string, array<int>>")), lambda c: F.size(c))
    return F.when(first_only, F.coalesce(F.get(sizes, F.lit(0)), F.when(sizes.isNotNull(), 0))).otherwise(F.aggregate(sizes, F.lit(0), lambda a, n: a + n))


def region_words(x: Column, y: Column, z: Column, edge: float = 0.15) -> Column:
    """Where a centroid lies relative to the whole, in words."""
    side = lambda c, up, down: F.when(c > edge, up).when(c < -edge, down)
    words = F.concat_ws("-", side(x, "right", "left"), side(z, "front", "behind"), side(y, "top", "bottom"))
    return F.when(words == "", "center").otherwise(words)
