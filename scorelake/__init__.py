"""scorelake: behavioural credit-risk scoring jobs on Spark DataFrames.

Every job is a plain ``DataFrame -> DataFrame`` function; batch and stream
share them.  See README.md for the module map.
"""

__version__ = "0.1.0"
