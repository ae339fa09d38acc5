"""Queries over the given tables, each with its SQL counterpart where SQL can say it."""

from catalog import access, cleaning, evolution, layout, reports, review, shapes

GROUPS = (reports, review, access, cleaning, layout, shapes, evolution)
