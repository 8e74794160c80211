"""Spark-first analytics for recorded event data: spike trains, stimulus intervals, probe geometry and voltage."""
