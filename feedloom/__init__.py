"""feedloom: feedback-quality analytics for agent skills on Spark DataFrames.

Every operator takes DataFrames (and plain parameters) and returns DataFrames.
Nothing here holds a global session; callers pass ``spark`` where one is needed.
"""

__version__ = "0.1.0"
