"""Public-procurement analytics as Spark DataFrame jobs.

Every public function takes and returns DataFrames (or Columns); nothing is collected.
"""
