"""vigil: behavioural risk analytics over activity logs, written as Spark jobs."""
