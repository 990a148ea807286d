"""eventlift: event-impact analytics as Spark jobs.

Guest lists are linked to accounts, order value is measured before and after an
event, a matched control group is built, and treatment is compared with control
on spend, activation and membership. Every operator takes and returns DataFrames.
"""

from eventlift.functions.periods import EventSpec, Period
from eventlift.plans.study import EventStudy, StudyTables
from eventlift.sources.workspace import Workspace

__all__ = ["EventSpec", "EventStudy", "Period", "StudyTables", "Workspace"]
