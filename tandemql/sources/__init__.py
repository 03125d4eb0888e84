"""Where tables come from and go to: files, LOAD DATA and OUTFILE, backend urls for JDBC."""
