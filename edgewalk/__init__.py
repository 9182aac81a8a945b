"""edgewalk: labelled directed multigraphs, random walks and masked edge views as Spark jobs."""
