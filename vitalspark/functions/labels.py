"""Names, labels and lists in strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .signals import finite


def mode_label(mode: Column, fps: Column) -> Column:
    """A preprocessing mode with its simulated rate, if it has one."""
    return F.concat(mode, F.coalesce(F.concat(F.lit(" @ "), fps.cast("string"), F.lit(" Hz")), F.lit("")))


def bpm_text(value: Column, signed: bool = False) -> Column:
    """A rate to one digit; dashes for an unknown one."""
    known = finite(value)
    return F.when(known.isNull(), "--").otherwise(F.format_string("%+.1f bpm" if signed else "%.1f bpm", known))


def number_list(text: Column) -> Column:
    """The numbers of a comma list; what isn't one is left out."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())


def condition_name(stem: Column) -> dict[str, Column]:
    """Subject, condition, lighting and state of a stem P<subject>_<condition>: four lightings at rest, the same after exercise."""
    condition = F.regexp_extract(stem, r"^P([^_]+)_(\d+)$", 2).try_cast("int")
    subject = F.regexp_extract(stem, r"^P([^_]+)_(\d+)$", 1)
    return {"subject": F.when(subject != "", subject), "condition": condition, "lighting": ((condition - 1) % 4 + 1).cast("int"), "state": F.when(condition <= 4, "rest").when(condition > 4, "post_exercise")}




def drive_name(subject: Column, segment: Column, actions: dict[str, str]) -> dict[str, Column]:
    """Vehicle, gender and lighting by the letters of a subject, road and action by those of a segment; unknown actions stay as written."""
    letter = lambda c, k: F.substring(c, k, 1)
    rest = F.substring(segment, 2, 100)
    action = rest
    for code, name in actions.items():
        action = F.when(rest == code, name).otherwise(action)
    return {"vehicle": letter(subject, 1), "gender": letter(subject, 2), "lighting": letter(subject, 3), "road": letter(segment, 1), "action": action}
