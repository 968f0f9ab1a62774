"""graphkin: matching the entities of two attributed graphs, as Spark DataFrame algebra."""
