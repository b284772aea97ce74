"""Monthly sales, renewal and forecast reports for a subscription business."""

from tidemark.functions.month import MonthWindow
from tidemark.sources.tables import Tables

__all__ = ["MonthWindow", "Tables"]
