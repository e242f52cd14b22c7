"""moodweave: dialogue affect and personality-trait analytics on Spark.

Every operator is a DataFrame -> DataFrame function built from Spark SQL
expressions, so Catalyst plans it and the cluster executes it.
"""

from moodweave.session import get_session, checkpoint_root

__all__ = ["get_session", "checkpoint_root"]
