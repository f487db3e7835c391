"""Reading, joining and writing archives of dated documents."""
