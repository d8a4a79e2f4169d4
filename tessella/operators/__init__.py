"""Operators beside those of :class:`tessella.plans.Segments`: blocks, arrays, offsets, schedules."""
