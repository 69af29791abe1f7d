"""Where data comes from: landed response pages and the requests that fetch them."""
