"""Clean messy tables and grade how clean they are, as Spark jobs.

functions  Column -> Column expressions (strip, dates, amounts, emails, dirt)
operators  DataFrame -> DataFrame jobs (dedup, fills, ids, profile, grade, report)
sources    text tables, task catalog, episode logs
plans      declarative cleaning specs, synthetic domains, task suites
queries    the registered checks, each with its SQL twin
"""
