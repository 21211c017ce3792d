"""Operators over observations, indicators, districts, plans and tasks.

Observations have indicator_id, district_id (null: national), year, period, period_no and
value.  Every operator works on all indicators at once, so a page of many cards is one job.
"""
