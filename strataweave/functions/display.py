"""Values for viewers and text output, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PRIORITY

# Fixed values of the viewer.
LAYER_COLORS = {"structural": "#94a3b8", "change": "#f59e0b", "defect": "#ef4444"}
LAYER_DASH = {"structural": "none", "change": "6,3", "defect": "3,3"}
LAYER_WIDTH = {"structural": 1.5, "change": 3.0, "defect": 4.0}
SIGNAL_COLORS = {"ticking_bomb": "#dc2626", "fragile_boundary": "#ef4444", "ghost_coupling": "#f59e0b", "over_engineering": "#6b7280", "stable_core": "#10b981"}
SIGNAL_ORDER = ("ticking_bomb", "fragile_boundary", "dependency_cycle", "ghost_coupling", "god_module", "shotgun_surgery", "unstable_dependency", "over_engineering", "stable_core")
DOT_STYLES = {"ghost_coupling": "style=dashed, color=purple", "fragile_boundary": "style=bold, color=red", "over_engineering": "style=dotted, color=gray"}
MERMAID_ARROWS = {"ghost_coupling": "-.->", "fragile_boundary": "==>"}


def derive_module(path: Column, prefix: Column) -> Column:
    """The first folder below the common prefix; root for files right there."""
    below = F.when((prefix != "") & path.startswith(prefix), F.ltrim(F.substr(path, F.length(prefix) + 1), F.lit("/"))).otherwise(path)
    return F.when(below.contains("/"), F.substring_index(below, "/", 1)).otherwise("root")


def decimals(value: Column, digits: int) -> Column:
    """A number's text with that many digits, rounded by what the double is and not by how it prints: 1.15, which is a
    little less, to 1.1, and 1.25 to the even 1.2; format_string's %f rounds the printed digits, and halves up."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits))


def short_number(value: Column) -> Column:
    return F.when(value >= 1000, F.concat(decimals(value / 1000.0, 1), F.lit("k"))).otherwise(value.cast("string"))


def short_path(path: Column, most: int = 30) -> Column:
    """At most `most` characters: the last folder and the name, or the name's end."""
    name = F.substring_index(path, "/", -1)
    two = F.concat(F.lit(".../"), F.substring_index(path, "/", -2))
    end = F.when(F.size(F.split(path, "/")) <= 2, F.right(path, F.lit(most))).otherwise(F.right(name, F.lit(most)))
    return F.when(F.length(path) <= most, path).when((F.size(F.split(path, "/")) > 2) & (F.length(two) <= most), two).otherwise(end)


def mermaid_id(path: Column) -> Column:
    return F.translate(path, "/.:", "___")


def heat_color(score: Column) -> Column:
    return F.when(score > 0.7, "red").when(score > 0.4, "orange").otherwise("lightblue")


def dot_style(signal: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in DOT_STYLES.items() for x in kv])[signal], F.lit("color=black"))


def mermaid_arrow(signal: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in MERMAID_ARROWS.items() for x in kv])[signal], F.lit("-->"))


def priority(signal: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[signal]


def color_value(value: Column, largest: Column) -> Column:
    return value / F.greatest(largest, F.lit(0.01))


def normalize(value: Column, largest: Column) -> Column:
    return F.when(largest <= 0, 0.0).otherwise(F.greatest(F.least(value / largest, F.lit(1.0)), F.lit(0.0)))


def link_distance(weight: Column) -> Column:
    return 80.0 / F.greatest(weight, F.lit(0.1))


def node_radius(loc: Column) -> Column:
    return F.greatest(F.sqrt(loc) * 0.8, F.lit(6.0))


def age_days(last_changed: Column, now: Column) -> Column:
    return F.datediff(now, last_changed)


def risk_level(hotspot: Column, has_bomb: Column, has_fragile: Column, has_ghost: Column) -> Column:
    return F.when((hotspot > 0.8) | has_bomb, "critical").when((hotspot > 0.6) | has_fragile, "high").when((hotspot > 0.3) | has_ghost, "medium").otherwise("low")
