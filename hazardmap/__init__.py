"""Danger maps and evacuation routes from crowd-sourced field reports, as Spark jobs."""
