SF = "/root/testdata/sf0.01"
