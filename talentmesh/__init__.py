"""talentmesh: bulk member/job profile extraction and matching on Spark."""

__version__ = "0.1.0"
