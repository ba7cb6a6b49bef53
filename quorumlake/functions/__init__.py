"""quorumlake.functions"""
