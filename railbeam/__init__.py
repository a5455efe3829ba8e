"""Rail timetable and punctuality analytics as Spark jobs."""
