"""Question banks and text corpora as Spark jobs: functions from DataFrame to DataFrame and from Column to Column."""
