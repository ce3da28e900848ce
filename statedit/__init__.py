"""Statistical data editing as Spark jobs.

Every public function takes DataFrames and returns a lazy DataFrame unless its
name says otherwise (``write_*``, ``require_*``, ``apply_*`` run jobs).
"""

__version__ = "0.1.0"
